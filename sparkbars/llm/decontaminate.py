"""Benchmark decontamination over training suffix arrays.

Every task builds suffix arrays over shards of its documents' words and
binary-searches each test suffix in them: the neighbours of the place where it
would go give its longest verbatim match, and the interval of suffixes that
begin with one of its windows gives all places where the window occurs. Whole
documents lie in one shard, so nothing is shuffled. Words that no test item
has are one separator to which nothing matches; suffixes that begin with such
a word, or meet one within the shortest window, cannot match a window and are
left out of the array.

Test items are written to the shared folder in blocks of bounded size, and
tasks read block by block, so their number is not bounded by a broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import arrow_schema, filesystem

WINDOW = 13
#: UTF-8 bytes of documents in one suffix array (a longer document has one of its own).
SHARD_BYTES = 8 << 20
#: UTF-8 bytes of test items in one block.
BLOCK_BYTES = 16 << 20
#: Words compared at once (bounds the memory of a comparison, whatever the items' length).
CELLS = 1 << 20

#: ASCII but digits and letters to spaces, A-Z to a-z; other bytes stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class TestBlock:
    """Words of a block of test items, once and one item behind the other; its
    suffixes and distinct windows are places and lengths in them."""

    __test__ = False

    def __init__(self, item_ids: list, texts: list[bytes | None], window: int):
        self.items = ["" if i is None else str(i) for i in item_ids]
        self.vocab: dict[bytes, int] = {}
        numbered = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(t)], np.int32) for t in texts]
        n = np.array([len(x) for x in numbered], np.int64)
        self.words = np.concatenate([*numbered, np.zeros(0, np.int32)])
        self.item = np.repeat(np.arange(len(n)), n)
        self.position = np.arange(len(self.words)) - np.repeat(np.cumsum(n) - n, n)
        self.left = n[self.item] - self.position  # words of each suffix
        # windows: equal ones are one, at their first place
        width = np.minimum(window, n)[self.item]
        places = np.flatnonzero(self.left >= width)
        shown = np.zeros((len(places), int(width.max(initial=1))), np.int32)
        for k in range(shown.shape[1]):
            inside = k < width[places]
            shown[inside, k] = self.words[places[inside] + k]
        _, first, same = np.unique(shown.view(f"V{4 * shown.shape[1]}")[:, 0], return_index=True, return_inverse=True)
        self.start, self.length = places[first], width[places[first]]
        pairs = np.unique(same.astype(np.int64) * max(1, len(n)) + self.item[places])
        self._owner, of = pairs % max(1, len(n)), pairs // max(1, len(n))
        self._bounds = np.searchsorted(of, np.arange(len(first) + 1))
        self.shortest = int(self.length.min(initial=1 << 30))

    def owners(self, w: int) -> list[int]:
        """Items that have window ``w``."""
        return self._owner[self._bounds[w] : self._bounds[w + 1]].tolist()


def suffix_array(words: np.ndarray, depth: int, shortest: int) -> np.ndarray:
    """Starts of the suffixes in order of their first ``depth`` words at least
    (0: separator), but for those with a separator among the first ``shortest``."""
    here = np.arange(len(words))
    stops = np.r_[-1, np.flatnonzero(words == 0), len(words)]
    behind = np.searchsorted(stops, here)
    run = stops[behind] - here  # words up to the next separator
    at = np.flatnonzero(run >= max(1, shortest))
    # ranks by 1, 2, 4, ... words (prefix doubling), in runs that have such a suffix
    long = (run > 0) & (stops[behind] - stops[behind - 1] > shortest)
    ranked, rank, k = np.flatnonzero(long), words.astype(np.int64), 1
    while k < depth and len(at):
        further = np.where(run[ranked] > k, rank[np.minimum(ranked + k, len(words) - 1)], 0)
        _, by = np.unique(rank[ranked] * (int(rank.max()) + 1) + further, return_inverse=True)
        rank[ranked], k = by + 1, 2 * k
    return at[np.argsort(rank[at], kind="stable")]


def _common(words: np.ndarray, at: np.ndarray, sought: np.ndarray, start: np.ndarray, length: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Common words of ``words`` from ``at`` and of the ``length`` words of ``sought``
    from ``start``, if the first ``known`` are; the last of ``words`` is a separator."""
    common, step = known.astype(np.int64), 16
    open_ = np.flatnonzero(common < length)
    while open_.size:
        further, batch = [], max(1, CELLS // step)
        for lo in range(0, len(open_), batch):
            rows = open_[lo : lo + batch]
            k = common[rows, None] + np.arange(step)
            differ = words[np.minimum(at[rows, None] + k, len(words) - 1)] != sought[np.minimum(start[rows, None] + k, len(sought) - 1)]
            differ |= k >= length[rows, None]
            ends = differ.any(axis=1)
            common[rows] += np.where(ends, differ.argmax(axis=1), step)
            further.append(rows[~ends])
        open_, step = np.concatenate(further), min(4 * step, 4096)
    return common


def _search(words: np.ndarray, array: np.ndarray, sought: np.ndarray, start: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all runs of ``length`` words from ``start`` at once: how many
    suffixes are before each (``after``: or begin with it)."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(array), np.int64)
    # words in common with the suffixes at both bounds, so with all between them
    at_lo, at_hi = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        at, s, n = array[mid], start[open_], length[open_]
        common = _common(words, at, sought, s, n, np.minimum(at_lo[open_], at_hi[open_]))
        last = np.minimum(common, n - 1)
        left = np.where(common == n, after, words[at + last] < sought[s + last])
        lo[open_[left]], at_lo[open_[left]] = mid[left] + 1, common[left]
        hi[open_[~left]], at_hi[open_[~left]] = mid[~left], common[~left]
    return lo


def scan_shard(texts: list[bytes | None], block: TestBlock):
    """-> (words per document, hit mask over all words, word offset per document,
    {document: set of items}, per document the longest match (words, word of the document, item, word of the item))."""
    tokens = [words_of(t) for t in texts]
    n = np.array([len(t) for t in tokens], np.int64)
    start = np.cumsum(n) - n
    get = block.vocab.get
    depth = int(block.left.max(initial=1))
    # a separator behind each document
    words = np.zeros(int(n.sum()) + len(texts), np.int32)
    at = start + np.arange(len(texts))
    for a, t in zip(at, tokens):
        words[a : a + len(t)] = [get(w, 0) for w in t]
    hit = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set] = {}
    longest: dict[int, tuple] = {}
    array = suffix_array(words, depth, block.shortest) if len(block.length) else np.zeros(0, np.int64)
    if len(array):
        lo, hi = (_search(words, array, block.words, block.start, block.length, after) for after in (False, True))
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        which = np.repeat(found, count)
        place = array[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]]
        np.add.at(hit, place, 1)
        np.add.at(hit, place + block.length[which], -1)
        doc = np.searchsorted(at, place, side="right") - 1
        for d, w in set(zip(doc.tolist(), which.tolist())):
            items.setdefault(d, set()).update(block.owners(w))
        every = np.arange(len(block.words))
        goes = _search(words, array, block.words, every, block.left, False)
        for near in (np.maximum(goes - 1, 0), np.minimum(goes, len(array) - 1)):
            common = _common(words, array[near], block.words, every, block.left, np.zeros(len(every), np.int64))
            for s in np.flatnonzero(common >= block.shortest).tolist():
                p = int(array[near[s]])
                d = int(np.searchsorted(at, p, side="right") - 1)
                match = (int(common[s]), -(p - int(at[d])), -int(block.item[s]), -int(block.position[s]))
                longest[d] = max(longest.get(d, match), match)
    mask = np.cumsum(hit[:-1]) > 0
    return n, mask, at, items, longest


def _files(folder: str) -> list[str]:
    fs, path = filesystem(folder)
    return sorted(f.path for f in fs.get_file_info(FileSelector(path)) if f.path.endswith(".parquet"))


def _load(folder: str, file: str, window: int) -> TestBlock:
    t = pq.ParquetFile(filesystem(folder)[0].open_input_file(file)).read()
    return TestBlock(t.column("item_id").to_pylist(), t.column("text").cast(pa.large_binary()).to_pylist(), window)


def write_tests(spark: SparkSession, items: DataFrame) -> str:
    """Test items in files of about BLOCK_BYTES in the shared folder."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    folder = scratch_path(spark, "test-items")
    items.select("item_id", "text").repartition(1 + size // BLOCK_BYTES).write.parquet(folder)
    return folder


def scan(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` (with ``text``) plus ``n_words, n_hit, n_items, items`` (ids as
    sorted strings), ``items_sha256, longest`` (words of the longest verbatim
    match; with where it is in document and item) and ``contaminated``: of the
    words at least one in ``share`` is inside an occurrence of a window.

    A window is ``window`` consecutive words of an item, or the whole item if it
    has fewer; items and documents without words have none. Null items go by an
    empty id; repeated items count once, as their id. Without items nothing is
    contaminated. ``docs`` must not have the columns that are added.
    """
    folder = write_tests(spark, items)
    added = ("n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, "
             "longest struct<words: bigint, doc_word: bigint, item_id: string, item_word: bigint>, contaminated boolean")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(added).fields])
    arrow, given = arrow_schema(schema), len(docs.columns)

    def results(texts: list, blocks) -> list[list]:
        n, mask, at, items_of, longest = None, None, None, {}, {}
        for b in blocks:
            n, hit, at, found, far = scan_shard(texts, b)
            mask = hit if mask is None else mask | hit
            for d, s in found.items():
                items_of.setdefault(d, set()).update(b.items[k] for k in s)
            for d, (words, p, k, q) in far.items():
                match = (words, -p, b.items[-k], -q)
                if d not in longest or words > longest[d][0]:
                    longest[d] = match
        if n is None:
            n, at = [len(words_of(t)) for t in texts], [0] * len(texts)
        rows = []
        for d in range(len(texts)):
            words, ids = int(n[d]), sorted(items_of.get(d, ()))
            hits = int(mask[at[d] : at[d] + words].sum()) if mask is not None else 0
            far = longest.get(d)
            rows.append([words, hits, len(ids), ids, hashlib.sha256(",".join(ids).encode()).hexdigest(),
                         None if far is None else dict(zip(("words", "doc_word", "item_id", "item_word"), far)), hits > 0 and share * hits >= words])
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, only = _files(folder), None

        def blocks():
            nonlocal only
            if len(files) == 1:
                only = only or _load(folder, files[0], window)
                yield only
            else:
                yield from (_load(folder, f, window) for f in files)

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            rows = results(t.column("text").cast(pa.large_binary()).to_pylist(), blocks())
            for k, field in enumerate(list(arrow)[given:]):
                t = t.append_column(field.name, pa.array([r[k] for r in rows], type=field.type))
            yield from t.to_batches()

        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                held.append(part)
                size += part.column("text").nbytes
                if size >= SHARD_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(run, schema)


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the contaminated ones."""
    return scan(spark, docs, items, **how).filter(~F.col("contaminated")).select(*[f"`{c}`" for c in docs.columns])

"""Alignment of two tokenizers' ids on the bytes of every text.

Both tokenizers cover the bytes of a space and the text. Where a token of each
ends, a group ends: the shortest stretches that both divide into whole tokens.
Tokens of a group that overlap are links.

A text is a sequence of fragments of byte ranges, an associative monoid: a
range holds the tokens that begin in it. Up to the first place where both begin
one is its open prefix, from the last such place on its open suffix, and what
lies between are closed groups; a range without such a place is all open. To
compose two fragments, the suffix of the first and the prefix of the second
become one closed group. Texts of up to CHUNK bytes are one range. Longer ones
are dealt out as ranges over the tasks of a shuffle and composed by a tree,
FAN_IN neighbours at a time, so no task encodes more than a few ranges of one
text.

Neither tokenizer joins what is before a space, tab or line end behind a
character that is none (that is checked in the second's vocabulary), so a text's
parts are encoded alone and remembered, with their groups and links.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import scratch_path
from .common import arrow_schema, filesystem, written

#: Bytes of a range, and fragments composed at a time.
CHUNK = 32 << 10
FAN_IN = 16
#: Parts that a worker remembers (and 16 times as many characters); of more, those that come most often stay.
REMEMBERED = 400_000
#: Characters of texts that are looked up at once.
GROUP_CHARS = 1 << 20
#: Pairs whose counts a worker looks up in a sorted table (17 bytes each); more are joined.
LOOKED_UP = 4_000_000
LOOKED_UP_ROWS = 512
#: Ranges of one encoding task on average, and the most tasks.
TASK_RANGES, MAX_TASKS = 64, 10_000

#: Fixed value: how byte-level BPE divides a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_ODD_ASCII = [c for c in _SPACES if c < "\x80" and c not in " \n"]
_ODD = [c for c in _SPACES if c not in " \n"]


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's characters: printable bytes stand for themselves, the
    others, in order, for the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Groups:
    """Closed groups: their text, number, and links as (a << 32 | b) with counts."""

    text: str = ""
    n: int = 0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def plus(self, other: Groups) -> Groups:
        if not self.n or not other.n:
            return self if self.n else other
        return Groups(f"{self.text};{other.text}", self.n + other.n,
                      *summed(np.concatenate([self.pairs, other.pairs]), np.concatenate([self.times, other.times])))


@dataclass
class Fragment:
    """Of a byte range: open prefix, closed groups and open suffix (ids of both
    sides); without a ``cut`` all is in the prefix. ``bad``: bytes differ."""

    cut: bool = False
    prefix: tuple = ((), ())
    groups: Groups = field(default_factory=Groups)
    suffix: tuple = ((), ())
    n_a: int = 0
    n_b: int = 0
    bad: bool = False


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, which = np.unique(pairs, return_inverse=True)
    return kinds, np.bincount(which, times, len(kinds)).astype(np.int64)


class Aligner:
    """Both tokenizers of a worker, and the parts it remembers."""

    def __init__(self, a_path: str, b_path: str):
        self.a: Tokenizer | None = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.ranked = self._by_rank(a_path, vocabulary)
        if self.ranked:
            self.a = None  # one of them is enough to hold
        self.written = [f"{i}{end}" for side, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(side))]
        self.a_size, self.b_size = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        joined = {m for p in pieces for m in re.findall(r"(?<=[^\s▁])[\s▁]", p)}
        cuts = [c for c in " \n\t\x0b\x0c" if ("▁" if c == " " else c) not in joined]
        self.plain = {" ", "\n"} <= set(cuts)
        self.cut = re.compile(rf"(?<=\S)(?=[{''.join(cuts)}])") if cuts else None
        #: The same in bytes, but only behind printable ASCII.
        self.byte_cut = re.compile(rf"(?<=[!-~])(?=[{''.join(cuts)}])".encode()) if cuts else None
        self.lead = len(self.b.encode("x"))
        self._forget()

    def _by_rank(self, path: str, vocabulary: dict[str, int]) -> tiktoken.Encoding | None:
        """The same tokenizer by ranks, which encodes faster; None if its file
        divides texts otherwise or does not number tokens in the order of their merges."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        order = [vocabulary.get("".join(m), -1) for m in merges]
        split = spec["pre_tokenizer"] or {}
        same = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["normalizer"]
        if not same or order != sorted(set(order)):
            return None
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes) if b}, special_tokens={})

    def _forget(self, used: int = 0) -> None:
        """Remembers only the parts that came in ``used`` look-ups (0: none)."""
        if not used:
            self.known, self.chars, self.texts = {}, 0, []
            self.ids = {"a": np.zeros(0, np.int32), "b": np.zeros(0, np.int32), "links": np.zeros(0, np.int64)}
            self.ends = {k: np.zeros(1, np.int64) for k in self.ids}  # of each part's entries in ids
            self.n_groups, self.bad, self.used = np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, np.int32)
            return
        kept = np.flatnonzero(self.used >= used)
        stays = (self.used >= used).tolist()
        self.known = dict(zip([p for p, s in zip(self.known, stays) if s], range(len(kept))))
        self.chars = sum(map(len, self.known))
        self.texts = [t for t, s in zip(self.texts, stays) if s]
        sizes = {k: np.diff(e)[kept] for k, e in self.ends.items()}
        self.ids = {k: self._entries(k, kept) for k in self.ids}
        self.ends = {k: np.concatenate([[0], np.cumsum(n)]) for k, n in sizes.items()}
        self.n_groups, self.bad, self.used = self.n_groups[kept], self.bad[kept], self.used[kept] // 2

    def parts(self, text: str) -> list[str]:
        """Parts of a space and the text; a part that is a space and other
        characters goes without the space."""
        odd = _ODD_ASCII if text.isascii() else _ODD
        if self.plain and text[:1] not in " \n" and not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in odd)):
            return text.replace("\n", " \n").split(" ")
        return self.context_parts(f" {text}")

    def context_parts(self, context: str) -> list[str]:
        """The same of a stretch that begins and ends where parts do."""
        found = self.cut.split(context) if self.cut else [context]
        return [p[1:] if p[0] == " " and not p[1:2].isspace() else p for p in found]

    def look_up(self, parts: list[str]) -> np.ndarray:
        """Numbers of remembered parts; new ones are learned in one call."""
        if len(self.known) > REMEMBERED or self.chars > 16 * REMEMBERED:
            often = 2
            while (self.used >= often).sum() > REMEMBERED // 2:
                often *= 2
            self._forget(often)
            if self.chars > 8 * REMEMBERED:
                self._forget()
        found = list(map(self.known.get, parts))
        if None in found:
            new = list({p for p, i in zip(parts, found) if i is None})
            first = len(self.known)
            self._learn([p if p[:1].isspace() else f" {p}" for p in new])
            self.known.update(zip(new, range(first, first + len(new))))
            self.chars += sum(map(len, new))
            found = [self.known[p] if i is None else i for p, i in zip(parts, found)]
        found = np.array(found, np.int64)
        self.used += np.bincount(found, minlength=len(self.used)) > 0
        return found

    def _learn(self, parts: list[str]) -> None:
        a, a_ends = self._a_ids(parts)
        b_lists = [ids[self.lead :] for ids in self.b.encode([f"x{p}" for p in parts], num_threads=1)]
        b = np.array([i for ids in b_lists for i in ids], np.int64)
        b_ends = np.cumsum([0, *map(len, b_lists)])
        bad = self._differ(parts, a.tolist(), a_ends.tolist(), b.tolist(), b_ends.tolist())
        a_stays, b_stays = (np.repeat(~bad, np.diff(e)) for e in (a_ends, b_ends))
        a, b = a[a_stays], b[b_stays]
        a_ends, b_ends = (np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(e)))]) for e in (a_ends, b_ends))
        written_, links, n_links, last = self.align(a, b)  # every part ends a group
        groups, n_links = (np.concatenate([[0], np.cumsum(n)])[a_ends] for n in (last, n_links))
        strings, at = list(map(self.written.__getitem__, written_.tolist())), (a_ends + b_ends).tolist()
        self.texts += ["".join(strings[lo:hi])[:-1] for lo, hi in zip(at, at[1:])]
        for name, ids, ends in (("a", a, a_ends), ("b", b, b_ends), ("links", links, n_links)):
            had = self.ids[name]
            self.ids[name] = np.concatenate([had, ids.astype(had.dtype)])
            self.ends[name] = np.concatenate([self.ends[name], ends[1:] + len(had)])
        self.n_groups = np.concatenate([self.n_groups, np.diff(groups).astype(np.int32)])
        self.bad = np.concatenate([self.bad, bad])
        self.used = np.concatenate([self.used, np.zeros(len(bad), np.int32)])

    def _differ(self, parts: list[str], *sides: list[int]) -> np.ndarray:
        """Whether the bytes of either side's tokens are not a part's; sides: ids and ends by part."""
        a, a_ends, b, b_ends = sides
        raw = [p.encode() for p in parts]
        sizes = np.cumsum([0, *map(len, raw)])
        one, even = b"".join(raw), True
        for ids, ends, table, size in ((a, a_ends, self.a_bytes, self.a_size), (b, b_ends, self.b_bytes, self.b_size)):
            even = even and np.array_equal(np.concatenate([[0], np.cumsum(size[ids])])[ends], sizes) and b"".join(map(table.__getitem__, ids)) == one
        if even:
            return np.zeros(len(parts), bool)
        return np.array([b"".join(map(self.a_bytes.__getitem__, a[lo:hi])) != r or b"".join(map(self.b_bytes.__getitem__, b[lo2:hi2])) != r
                         for lo, hi, lo2, hi2, r in zip(a_ends, a_ends[1:], b_ends, b_ends[1:], raw)])

    def _a_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the first tokenizer, and where each part's end."""
        if not self.ranked:
            found = self.a.encode(parts, is_pretokenized=True, add_special_tokens=False)
            return np.array(found.ids, np.int64), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(parts) + 1))
        if not any(p[-1].isspace() for p in parts):  # then all in one text
            ids = np.array(self.ranked.encode_ordinary("".join(parts)), np.int64)
            upto, sizes = np.concatenate([[0], np.cumsum(self.a_size[ids])]), np.cumsum([0, *(len(p.encode()) for p in parts)])
            ends = np.searchsorted(upto, sizes)
            if np.array_equal(upto[np.minimum(ends, len(ids))], sizes):
                return ids, ends
        lists = [self.ranked.encode_ordinary(p) for p in parts]
        return np.array([i for ids in lists for i in ids], np.int64), np.cumsum([0, *map(len, lists)])

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids that cover the same bytes -> the groups as numbers in ``written``,
        all links in order, the links of each a, and whether it ends a group."""
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        to = np.searchsorted(b_ends, a_ends)  # the b that holds a's last byte
        last = b_ends[to] == a_ends
        first = np.concatenate([[0], (to + last)[:-1]])[: len(a)]
        n = to - first + 1
        ends = np.cumsum(n)
        links = np.repeat(a, n) << 32 | b[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        last_b = np.zeros(len(b), bool)
        last_b[to[last]] = True
        group, group_b = np.cumsum(last) - last, np.cumsum(last_b) - last_b
        out = np.zeros(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate([[0], np.flatnonzero(last_b) + 1])[group]] = a + last * len(self.a_bytes)
        out[np.arange(len(b)) + (np.flatnonzero(last) + 1)[group_b]] = 2 * len(self.a_bytes) + b + last_b * len(self.b_bytes)
        return out, links, n, last

    def closed(self, a: np.ndarray, b: np.ndarray) -> Groups:
        if not len(a):
            return Groups()
        out, links, _, last = self.align(a, b)
        return Groups("".join(map(self.written.__getitem__, out.tolist()))[:-1], int(last.sum()), *summed(links, np.ones(len(links), np.int64)))

    def _entries(self, name: str, parts: np.ndarray) -> np.ndarray:
        """The parts' entries in ids[name], one part after another."""
        first, size = self.ends[name][parts], self.ends[name][parts + 1] - self.ends[name][parts]
        ends = np.cumsum(size)
        return self.ids[name][np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def whole(self, texts: list[str]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, pairs, times) of each text; of one
        whose bytes differ, nothing."""
        parts = [self.parts(t) if t else [] for t in texts]
        at = np.cumsum([0, *map(len, parts)])
        which = self.look_up([p for of_text in parts for p in of_text])
        text = np.repeat(np.arange(len(texts)), np.diff(at))
        bad = np.bincount(text, self.bad[which], len(texts)) > 0
        total = lambda n: np.bincount(text, n, len(texts)).astype(np.int64).tolist()
        sizes = {k: np.diff(self.ends[k]) for k in self.ends}
        n_a, n_b, n_links, n_groups = (total(x[which]) for x in (sizes["a"], sizes["b"], sizes["links"], self.n_groups))
        # links by text: of its distinct parts, as often as they come
        kinds, often = np.unique(text << 32 | which, return_counts=True)
        of, part = kinds >> 32, kinds & 0xFFFFFFFF
        size = sizes["links"][part]
        links = self._entries("links", part)
        of, often = np.repeat(of, size), np.repeat(often, size)
        by = np.lexsort((links, of))
        links, of, often = links[by], of[by], often[by]
        head = np.flatnonzero(np.concatenate([[True], (links[1:] != links[:-1]) | (of[1:] != of[:-1])])) if len(links) else np.zeros(0, np.int64)
        times = np.add.reduceat(often, head) if len(head) else often
        pairs, ends = links[head], np.searchsorted(of[head], np.arange(len(texts) + 1)).tolist()
        names = self.texts
        which, at = which.tolist(), at.tolist()
        for i in range(len(texts)):
            if bad[i] or not n_a[i]:
                yield 0, 0, 0, 0, "", pairs[:0], times[:0]
            else:
                yield n_a[i], n_b[i], n_groups[i], n_links[i], ";".join([names[k] for k in which[at[i] : at[i + 1]]]), pairs[ends[i] : ends[i + 1]], times[ends[i] : ends[i + 1]]

    def fragment(self, context: str, skip: int, keep: int) -> Fragment:
        """Of the bytes [skip, skip + keep) of ``context``, which begins and ends
        where parts do (a document's first range begins with the added space)."""
        which = self.look_up(self.context_parts(context))
        if self.bad[which].any():
            return Fragment(bad=True)
        a, b = (self._entries(side, which).astype(np.int64) for side in "ab")
        a_at, b_at = (np.cumsum(s) - s for s in (self.a_size[a], self.b_size[b]))
        a_in, b_in = ((s >= skip) & (s < skip + keep) for s in (a_at, b_at))
        a, b, a_at, b_at = a[a_in], b[b_in], a_at[a_in], b_at[b_in]
        both = np.intersect1d(a_at, b_at, assume_unique=True)
        if not len(both):
            return Fragment(False, (a, b), n_a=len(a), n_b=len(b))
        (i, i2), (j, j2) = (np.searchsorted(s, both[[0, -1]]) for s in (a_at, b_at))
        return Fragment(True, (a[:i], b[:j]), self.closed(a[i:i2], b[j:j2]), (a[i2:], b[j2:]), len(a), len(b))

    def compose(self, f: Fragment, g: Fragment) -> Fragment:
        if f.bad or g.bad:
            return Fragment(bad=True)
        join = lambda x, y: tuple(np.concatenate([np.asarray(u, np.int64), np.asarray(v, np.int64)]) for u, v in zip(x, y))
        n = f.n_a + g.n_a, f.n_b + g.n_b
        if not f.cut:
            return Fragment(g.cut, join(f.prefix, g.prefix), g.groups, g.suffix, *n)
        if not g.cut:
            return Fragment(True, f.prefix, f.groups, join(f.suffix, g.prefix), *n)
        return Fragment(True, f.prefix, f.groups.plus(self.closed(*join(f.suffix, g.prefix))).plus(g.groups), g.suffix, *n)

    def ranges(self, text: str, chunk: int = CHUNK) -> Iterator[tuple[str, int, int]]:
        """(context, skip, keep) of the byte ranges of a space and the text. A
        context takes in the parts that its range cuts; a range ends behind a
        part that is longer than a range, so no part is encoded more than a few times."""
        raw = f" {text}".encode()
        cuts = [m.start() for m in self.byte_cut.finditer(raw)] if self.byte_cut else []
        cuts = np.array([0, *cuts, len(raw)], np.int64)
        lo = 0
        while lo < len(raw):
            hi = min(lo + chunk, len(raw))
            k = int(np.searchsorted(cuts, hi))
            if cuts[k] - cuts[k - 1] > chunk:
                hi = int(cuts[k])
            first, last = int(cuts[np.searchsorted(cuts, lo, side="right") - 1]), int(cuts[np.searchsorted(cuts, hi)])
            yield raw[first:last].decode(), lo - first, hi - lo
            lo = hi


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One per worker process, so that what it remembers serves later tasks."""
    if (a, b) not in _ALIGNERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
_LINKS = "groups string, pairs array<bigint>, times array<bigint>"
_RANGE = "row bigint, at bigint, n bigint, context string, skip bigint, keep bigint"
_FRAGMENT = "row bigint, at bigint, n bigint, cut boolean, bad boolean, n_a bigint, n_b bigint, n_groups bigint, " + _LINKS + ", " + ", ".join(
    f"{side}_{x} array<bigint>" for side in ("prefix", "suffix") for x in "ab")


def _schema(ddl: str) -> pa.Schema:
    return arrow_schema(T.StructType.fromDDL(ddl))


def _put(doc_ids: pa.Array, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays([doc_ids, *arrays], names=["doc_id", *schema.names])


def _packed(row: int, at: int, n: int, f: Fragment) -> tuple:
    return (row, at, n, f.cut, f.bad, f.n_a, f.n_b, f.groups.n, f.groups.text, f.groups.pairs, f.groups.times, *map(np.asarray, (*f.prefix, *f.suffix)))


def _fragments(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(row, at, n, fragment, doc_id as an array of one) of each row."""
    columns = {n: batch.column(n) for n in batch.schema.names}
    ids = lambda name, i: columns[name][i].values.to_numpy(zero_copy_only=False).astype(np.int64)
    value = lambda name, i: columns[name][i].as_py()
    for i in range(batch.num_rows):
        groups = Groups(value("groups", i), value("n_groups", i), ids("pairs", i), ids("times", i))
        f = Fragment(value("cut", i), (ids("prefix_a", i), ids("prefix_b", i)), groups, (ids("suffix_a", i), ids("suffix_b", i)),
                     value("n_a", i), value("n_b", i), value("bad", i))
        yield value("row", i), value("at", i), value("n", i), f, columns["doc_id"].slice(i, 1)


def _long(spark: SparkSession, docs: DataFrame, a: str, b: str, chunk: int, fan_in: int, kind: str) -> DataFrame:
    """Texts of more than one range, by fragments and a tree of compositions."""
    ranged, fragment, whole = (f"doc_id {kind}, {ddl}" for ddl in (_RANGE, _FRAGMENT, f"{_COUNTS}, {_LINKS}"))
    range_fields, fragment_fields, whole_fields = map(_schema, (_RANGE, _FRAGMENT, f"{_COUNTS}, {_LINKS}"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                found = list(aligner(a, b).ranges(text.as_py(), chunk))
                rows = [(row, at, len(found), *r) for at, r in enumerate(found)]
                yield _put(pa.concat_arrays([batch.column("doc_id").slice(i, 1)] * len(rows)), rows, range_fields)
                row += 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["row", "at", "n", "context", "skip", "keep"]).to_pylist()
            for i, r in enumerate(rows):
                if i % FAN_IN == 0:  # learn the parts of some ranges in one call
                    aligner(a, b).look_up([p for x in rows[i : i + FAN_IN] for p in aligner(a, b).context_parts(x["context"])])
                f = aligner(a, b).fragment(r["context"], r["skip"], r["keep"])
                yield _put(batch.column("doc_id").slice(i, 1), [_packed(r["row"], r["at"], r["n"], f)], fragment_fields)

    def reduce(whole_texts: bool):
        def put(key: tuple[int, int], n: int, f: Fragment, doc_id: pa.Array) -> pa.RecordBatch:
            if not whole_texts:
                return _put(doc_id, [_packed(*key, n, f)], fragment_fields)
            groups = Groups() if f.bad else f.groups.plus(aligner(a, b).closed(*f.suffix))
            tokens = (0, 0) if f.bad else (f.n_a, f.n_b)
            return _put(doc_id, [(*tokens, groups.n, int(groups.times.sum()), groups.text, groups.pairs, groups.times)], whole_fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = held = last = count = None
            for batch in batches:
                for row, at, n, f, doc_id in _fragments(batch):
                    if (row, at // fan_in) == key:
                        held = aligner(a, b).compose(held, f)
                    else:
                        if key is not None:
                            yield put(key, count, held, last)
                        key, held = (row, at // fan_in), f
                    last, count = doc_id, -(-n // fan_in)
            if key is not None:
                yield put(key, count, held, last)

        return run

    # written once, so that row numbers are the same for all later tasks
    pieces = written(spark, docs.mapInArrow(cut, ranged), "align-ranges")
    n, n_ranges = pieces.agg(F.coalesce(F.max("n"), F.lit(1)), F.count("*")).first()
    tasks = min(MAX_TASKS, 1 + n_ranges // TASK_RANGES)
    found = pieces.repartition(tasks, "row", "at").mapInArrow(encode, fragment)
    while True:
        n, group = -(-n // fan_in), F.floor(F.col("at") / fan_in)
        found = found.repartition("row", group).sortWithinPartitions("row", "at")
        if n <= 1:
            return found.mapInArrow(reduce(True), whole)
        found = found.mapInArrow(reduce(False), fragment)


def align(spark: SparkSession, docs: DataFrame, a: str, b: str, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, text) -> ``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times``,
    one row per row.

    ``a``: file of a byte-level BPE of the tokenizers library; ``b``: of a
    sentencepiece BPE that puts a space in front. ``groups``: ids of each group,
    those of a and b divided by |, groups by ;. ``pairs``: each linked id pair as
    a << 32 | b, ``times`` its links. Null and empty texts, and texts that the
    bytes of either side's tokens do not give back, have no tokens: zeros, an
    empty text and empty lists. Repeated rows each have their row, doc_id may be
    null and of any type, other columns are left out. A text's groups must fit a
    row (2 GB, texts of about 300 MB)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    schema = _schema(f"{_COUNTS}, {_LINKS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0))
            group = (np.cumsum(sizes) - sizes) // GROUP_CHARS
            cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [len(sizes)]
            for lo, hi in zip(cuts, cuts[1:]):
                rows = list(aligner(a, b).whole(batch.column("text").slice(lo, hi - lo).to_pylist()))
                yield _put(batch.column("doc_id").slice(lo, hi - lo), rows, schema)

    short = F.coalesce(F.octet_length("text"), F.lit(0)) < chunk
    brief = docs.filter(short).mapInArrow(run, f"doc_id {kind}, {_COUNTS}, {_LINKS}")
    return brief.unionByName(_long(spark, docs.filter(~short), a, b, chunk, fan_in, kind))


def pair_documents(aligned: DataFrame) -> DataFrame:
    """``pair, n_docs, best``: how many rows hold each pair linked, and whether no
    other pair of its a is held by more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("most"))
    joined = counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a")
    return joined.select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def weigh(spark: SparkSession, aligned: DataFrame, looked_up: int = LOOKED_UP) -> DataFrame:
    """Adds ``n_best`` (links whose pair is the most frequent of its a) and
    ``count_sum`` (counts of the pairs, over links) to a written result of
    ``align`` with a column ``row`` that numbers its rows; ``pairs`` and
    ``times`` go. A table of up to ``looked_up`` pairs is read by every worker,
    more are joined."""
    path = scratch_path(spark, "align-pairs")
    pair_documents(aligned).write.parquet(path)
    counts = spark.read.schema("pair bigint, n_docs bigint, best boolean").parquet(path)
    left = aligned.drop("pairs", "times", "row")
    names = left.columns
    schema = T.StructType([*left.schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    if counts.count() > looked_up:
        each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.*").withColumnRenamed("pairs", "pair")
        sums = each.join(counts, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return aligned.join(sums, "row", "left").select(*names, zero("n_best"), zero("count_sum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n_docs, best = _table(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, LOOKED_UP_ROWS):
                batch = whole.slice(lo, LOOKED_UP_ROWS)
                pairs, times = batch.column("pairs"), np.asarray(batch.column("times").flatten())
                at = np.searchsorted(pair, np.asarray(pairs.flatten()))
                ends = np.concatenate([[0], np.cumsum(np.asarray(pairs.value_lengths()))])
                sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (times * best[at], times * n_docs[at])]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(np.diff(s)) for s in sums], names=[*names, "n_best", "count_sum"])

    return aligned.select(*names, "pairs", "times").mapInArrow(run, schema)


_TABLES: dict[str, tuple] = {}


def _table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if path not in _TABLES:
        fs, folder = filesystem(path)
        table = pq.read_table(folder, filesystem=fs, schema=pa.schema([("pair", pa.int64()), ("n_docs", pa.int64()), ("best", pa.bool_())]))
        pair, n_docs, best = (table.column(c).to_numpy() for c in ("pair", "n_docs", "best"))
        by = np.argsort(pair)
        _TABLES.clear()
        _ALIGNERS.clear()  # this worker's part of the encoding is done
        _TABLES[path] = pair[by], n_docs[by], best[by].astype(np.int64)
    return _TABLES[path]

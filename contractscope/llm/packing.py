"""Packing of tokenised documents into sequences: best-fit decreasing per partition, certified by lower bounds.

Pieces are dealt into partitions of bounded size. Each is packed by best-fit decreasing and compared with lower
bounds from dual feasible functions, which for all partitions together come from one count a length: where the number
of bins equals the bound, it is certified and packing ends. Else partitions with gaps give up their emptier bins; the
documents in these are dealt anew, so that the gaps of different partitions meet, and packed again, until one partition
holds them all or not even larger ones save a bin.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractscope.llm.frames import WordTable, blocks, cut, free_shuffles, gathered, lean, ragged


#: Between a letter and anything but a letter, a mark or an apostrophe a token ends, whatever lies around it;
#: _MARKED finds words with a mark, a letter whose lower case has one, or the begin of a special token.
_EDGE = re.compile(r"(?<=[^\W\d_])(?=[^'\w])|(?<=[^'\w])(?=[^\W\d_])|(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])")
_MARKED = re.compile("<\\||[\u0130\u0300-\u036f\u0483-\u0489\u0591-\u0902\u093a-\u0e4e\u0eb1-\u109d\u135d-\u1dff\u20d0-\u20f0\u2cef-\u2cf1\u2de0-\u2dff\u302a-\u309a\ua66f-\uabed\ufb1e-\ufe2f\U00010000-\U0010ffff]")


class WordCache:
    """Ids of words, in a table of bounded size that a worker's later tasks find again.

    The tokenizer drops white space, and neither its normaliser nor its pattern reaches across white space, so a text's
    ids are those of its words one after another. Within a word, a token ends where letters meet punctuation or digits,
    so a new word such as "word," is cut into two parts; words with an apostrophe or a combining mark beside such an
    edge stay whole there. A part of letters alone ends in exactly one id of an end-of-word piece, which tells new parts
    apart that are encoded in one go.
    """

    _kept: dict[str, WordCache] = {}

    def __init__(self, path: str, most: int = 250_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.table = WordTable(most, longest)
        self.parts: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    @classmethod
    def of(cls, path: str) -> WordCache:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _learn(self, words: list[str], known: dict[str, bytes]) -> None:
        plain = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some) or stops[-1] != len(ids):
                rest += some
                continue
            data, begin = ids.tobytes(), 0
            for w, end in zip(some, (4 * stops).tolist(), strict=True):
                known[w] = data[begin:end]
                begin = end
        for i in range(0, len(rest), 1000):
            some = rest[i : i + 1000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words that the table lacks."""
        if len(self.parts) > self.most // 4:
            self.parts = {}
        known = self.parts
        parts = [[w] if w.isalpha() or _MARKED.search(w) else _EDGE.split(w) for w in words]
        new = set().union(*parts).difference(known)
        self._learn(list(new), known)
        out = [known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for p in parts]
        for w in new:
            if len(w) > self.longest:
                del known[w]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and where each text's begin (with the end of the last)."""
        return ragged(*self.table.look_up(pc.ascii_split_whitespace(texts.fill_null("")), self._new), "<u4")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut only where over capacity.

    A null text counts as empty, so that document is its end_id alone. Narrow: no shuffle.
    """
    last = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCache.of(tokenizer)
        for batch in gathered(batches, 1, 1 << 22):
            ids, begin = words.encode(batch.column(1))
            rows = []
            for doc, a, z in zip(batch.column(0).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                data = ids[a:z].tobytes() + last
                for k, b in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[b : b + 4 * capacity]
                    rows.append((doc, k, b // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item by best-fit decreasing, and the number of bins.

    Open bins are kept by free space, and one integer has a bit for each free space that some bin has, so the
    tightest bin that fits is the lowest set bit from the item's length on.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for i in order.tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            space, b, n = capacity, n, n + 1
        where[i], offset[i] = b, capacity - space
        if left := space - size:
            free[left].append(b)
            mask |= 1 << left
    return where, offset, n


def lower_bound(lengths: np.ndarray, capacity: int, most_k: int = 20) -> int:
    """Fewest bins any packing needs, as far as two families of dual feasible functions can tell.

    For each threshold e up to half a bin, items over capacity - e count as a bin and those under e as nothing; the
    rest count as they are, or by the rounding function of order k (k + 1 parts of a bin, of which k make it full).
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity, most_k)


def bound_of_counts(count: np.ndarray, capacity: int, most_k: int = 20) -> int:
    """The same from the number of items of each length from 0 to capacity, however many items they are."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    e = np.arange(capacity // 2 + 1)
    for k in range(0, most_k + 1):
        if k:
            parts, odd = np.divmod((k + 1) * sizes, capacity)
            worth, full = np.where(odd == 0, parts * k, parts * (k + 1)), k * (k + 1)
        else:
            worth, full = sizes, capacity
        big = np.concatenate([[0], np.cumsum(count)])
        some = np.concatenate([[0], np.cumsum(count * worth)])
        total = (big[-1] - big[capacity - e + 1]) * full + some[capacity - e + 1] - some[e]
        best = max(best, int(-(-total.max() // full)))
    return best


def _packer(r: int, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs the items of one part in round r; _done unless the bin is among the part's emptier ones.

    A part whose bins are full is certified and keeps them all. Another, even one that needs as many bins as its own
    lower bound, keeps its fuller bins and gives up the emptiest ones, until those hold nine tenths of its free space:
    its gaps may take what another part can't place.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(np.int64)
        where, offset, n_bins = best_fit(lengths, capacity)
        done = np.ones(n_bins, bool)
        free = capacity - np.bincount(where, weights=lengths, minlength=n_bins)
        if free.any():
            order = np.argsort(-free, kind="stable")
            given = int(np.searchsorted(np.cumsum(free[order]), 0.9 * free.sum())) + 1
            done[order[:given]] = free[order[:given]] == 0
        first = np.int64((r << 34) + int(pdf["_part"].iloc[0])) << np.int64(21)
        return pd.DataFrame({"_row": pdf["_row"], "length": lengths, "sequence_id": first + where, "offset": offset, "_done": done[where]})

    return run


def _dealer(parts: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Deals the items of a batch round the parts by falling length, so that all parts get much the same lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf = pdf.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
                first = int(pdf["_row"].iloc[0]) * 2654435761 % parts
                yield pdf.assign(_part=((first + np.arange(len(pdf))) % parts).astype(np.int32))

    return run


def _bound(items: DataFrame, capacity: int) -> int:
    """Lower bound for all items together, from one row a length."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():
        count[length] = n
    return bound_of_counts(count, capacity)


def pack(items: DataFrame, capacity: int = 2048, per_part: int = 30_000, growth: int = 16) -> DataFrame:
    """Add sequence_id and offset to items (doc_id, piece, length, ...); lengths from 1 to capacity.

    Every item is placed exactly once; a sequence's items follow one another from offset 0 without gaps. Parts have
    about per_part items however many there are in all, dealt row by row, so repeated rows and hot documents spread
    evenly. Bins that parts with gaps give up are dealt anew into fewer parts and packed again, until one part holds what
    is left, or their bins are as few as the lower bound of what they hold. Where dealing anew saves no bin, parts are made twice as large, up to `growth` times per_part (which bounds a
    task's memory); only when these save nothing either, what was packed before stays. An empty table gives an empty result; other columns
    are kept, but for columns that have the names sequence_id and offset, which are replaced.
    """
    free_shuffles(items.sparkSession)
    rows = cut(items.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()))
    columns = rows.columns[:-1]
    open_ = rows.select("_row", "length")
    n, placed, before, bins_before, r, size = open_.count(), [], None, 0, 0, per_part
    while n:
        parts = blocks(n, size)
        dealt = open_.mapInPandas(_dealer(parts), "_row long, length long, _part int")
        made = cut(dealt.groupBy("_part").applyInPandas(_packer(r, capacity), "_row long, length long, sequence_id long, offset long, _done boolean"))
        bins = made.select("sequence_id").distinct().count()
        if before is not None and bins >= bins_before:
            if parts == 1 or size >= growth * per_part:
                placed.append(before)
                break
            size, r = 2 * size, r + 1
            continue
        if parts == 1 or bins == _bound(open_, capacity):
            placed.append(made)
            break
        before = made.filter("NOT _done")
        placed.append(made.filter("_done"))
        open_, n, bins_before, r = before.select("_row", "length"), before.count(), before.select("sequence_id").distinct().count(), r + 1
    out = rows.select("_row", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    for p in placed:
        out = out.unionByName(p.select("_row", "sequence_id", "offset"))
    return rows.join(out, "_row").select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack documents: one row per piece with its place."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)

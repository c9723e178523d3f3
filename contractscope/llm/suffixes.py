"""Removal of long repeated byte strings by sorting sampled suffixes, deep-shallow.

Any two equal strings of `least` bytes choose the same anchor: the leftmost least hash of their `gram`-byte grams. So
1. whole copies are set apart; every other document gives its anchors; those whose gram is met once in the corpus are dropped;
2. the rest meet by gram, with the bytes that a string through the anchor can reach: to the right of it, and to the
   left. Within a task both sides are sorted as suffixes: multikey quicksort on symbols of eight bytes down to a
   shallow depth, then a blind trie orders each group that still agrees. Common prefixes of sorted neighbours tell,
   for every string through an anchor, which others equal it; all but the earliest are marked;
3. marks come together by document, and what they cover is removed.

Rows that a task finds equal in all these bytes are marked at once and sent on only once; a gram met very often with
different surroundings is resolved string by string, in a second exchange by the strings' own hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractscope.llm.frames import cut, free_shuffles, lean
from contractscope.llm.shingles import mix

LEAST, GRAM = 100, 32
REACH = LEAST - GRAM  # how far left of its anchor a string can start
SHALLOW = 5  # symbols of eight bytes that multikey quicksort looks at
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_STEPS = [mix(np.array([k + 1000], np.uint64))[0] | np.uint64(1) for k in range(8)]


# --- anchors ----------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position on, by doubling."""
    h, width = _TABLE[data], 1
    for k in range(5):
        h = h[: len(h) - width] * _STEPS[k] + h[width:] if len(h) > width else h[:0]
        width *= 2
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, position in it, gram hash) of the anchors of every LEAST-byte string inside a piece."""
    none = np.zeros(0, np.int64)
    size = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    if len(data) < LEAST:
        return none, none, np.zeros(0, np.uint64)
    h = gram_hashes(data)
    low = np.uint64((1 << len(h).bit_length()) - 1)
    best = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), REACH + 1)
    end = np.cumsum(size)
    last = np.repeat(end - LEAST, size)[: len(best)]
    chosen = best[np.arange(len(best)) <= last] & low
    at = np.unique(chosen).astype(np.int64)
    piece = np.searchsorted(end, at, side="right")
    return piece, at - (end - size)[piece], h[at]


def segments(ids: list, texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Groups of (doc_id, offset, bytes) of about `most` bytes; a longer text is cut so that each LEAST-byte string is in just one cut."""
    out: tuple[list, list[int], list[bytes]] = ([], [], [])
    room = most
    for doc, text in zip(ids, texts, strict=True):
        text = text or b""
        for a in range(0, max(1, len(text) - LEAST + 1), most):
            part = text[a : a + most + LEAST - 1] if len(text) > most else text
            for x, y in zip(out, (doc, a, part), strict=True):
                x.append(y)
            room -= len(part)
            if room <= 0:
                yield out
                out, room = ([], [], []), most
    if out[0]:
        yield out


def anchors(docs: DataFrame, window: int = 1_000_000) -> DataFrame:
    """(route, doc_id, pos, known): within a task's window a gram goes to its meeting once; its repeats are known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, pos = h[order], doc[order], pos[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            alone = first & np.append(first[1:], True)
            route = np.where(first, h, mix(h + doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.view(np.uint64)))
            return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(doc), pa.array(pos), pa.array(~alone)], names=["route", "doc_id", "pos", "known"])

        for batch in batches:
            for ids, offset, parts in segments(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece, pos, h = anchors_of(parts)
                held.append((h, np.array(ids, np.int64)[piece], pos + np.array(offset, np.int64)[piece]))
                n += len(h)
                if n > window:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return docs.mapInArrow(lean(run), "route long, doc_id long, pos long, known boolean")


def repeated(found: DataFrame) -> DataFrame:
    """(doc_id, pos) of the anchors whose gram is met more than once. Streams over runs; memory does not grow with a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, open_ = None, None  # the last row is held back until its successor is seen

        def out(doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos)], names=["doc_id", "pos"])

        for batch in batches:
            if not batch.num_rows:
                continue
            route, doc, pos, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if open_ is not None:
                route, doc, pos, known = (np.concatenate([[a], b]) for a, b in zip(open_, (route, doc, pos, known), strict=True))
            same = route[1:] == route[:-1]
            keep = known.astype(bool) | np.append(same, False) | np.concatenate([[before is not None and route[0] == before], same])
            yield out(doc[:-1][keep[:-1]], pos[:-1][keep[:-1]])
            before = route[-2] if len(route) > 1 else before
            open_ = (route[-1], doc[-1], pos[-1], known[-1])
        if open_ is not None and (open_[3] or before == open_[0]):
            yield out(np.array([open_[1]], np.int64), np.array([open_[2]], np.int64))

    dealt = found.repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(lean(run), "doc_id long, pos long")


# --- surroundings -----------------------------------------------------------------------------------------------

SIDE = REACH  # bytes kept on each side of a gram; its own bytes are known by its 64-bit hash
_AROUND = "gram long, doc_id long, pos long, lefts int, rights int, around binary"


def surroundings(docs: DataFrame, kept: DataFrame, window: int = 200_000) -> DataFrame:
    """Each repeated anchor with the bytes around it; rows without them are marks (pos: start, rights: length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            doc, pos, left, right, around = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key, gram = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64)
            for word in np.ascontiguousarray(around[:, REACH : REACH + GRAM]).view(np.uint64).T:
                gram = mix(gram * _STEPS[1] + word)
            around = np.concatenate([around[:, :REACH], around[:, REACH + GRAM :]], axis=1)
            for word in around.view(np.uint64).T:
                key = mix(key * _STEPS[0] + word)
            key = mix(key + gram)
            order = np.lexsort((pos, doc, key, gram))  # alike rows lie side by side, which packs them well
            doc, pos, left, right, around, key, gram = (x[order] for x in (doc, pos, left, right, around, key, gram))
            same = np.concatenate([[False], (key[1:] == key[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (around[1:] == around[:-1]).all(axis=1) & (gram[1:] == gram[:-1])])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
            own = same & (doc == doc[head]) & (pos == pos[head])  # the same place of a repeated row
            mark = same & ~own
            gram[mark] = mix(gram[mark] + doc[mark].view(np.uint64) * _STEPS[2] + pos[mark].view(np.uint64))
            keep = ~own
            start, length = pos - left, np.minimum(LEAST, right) + left
            rows = np.where(mark, start, pos)
            data = [x.tobytes() for x in around[keep]]
            return pa.RecordBatch.from_arrays(
                [pa.array(gram[keep].view(np.int64)), pa.array(doc[keep]), pa.array(rows[keep]), pa.array(left[keep].astype(np.int32)), pa.array(np.where(mark, length, right)[keep].astype(np.int32)), pa.array(data, pa.binary(), mask=mark[keep])],
                names=["gram", "doc_id", "pos", "lefts", "rights", "around"],
            )

        for batch in batches:
            for doc, text, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = np.frombuffer(bytes(REACH) + text + bytes(LEAST), np.uint8)
                every = np.unique(np.array(places, np.int64))
                for a in range(0, len(every), window):
                    pos = every[a : a + window]
                    around = np.lib.stride_tricks.sliding_window_view(data, REACH + LEAST)[pos]
                    held.append((np.full(len(pos), doc), pos, np.minimum(REACH, pos), np.minimum(LEAST, len(text) - pos), around))
                    n += len(pos)
                    if n > window:
                        yield flush()
                        n = 0
        if n:
            yield flush()

    places = kept.groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    return docs.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(lean(run), _AROUND)


# --- deep-shallow sorting ---------------------------------------------------------------------------------------


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of equally long strings, and each one's common prefix with the one before it.

    A node keeps only a depth and its children by the byte there. A string goes down blindly, is compared once with
    the leaf it comes to, and branches off where they first differ.
    """
    m = len(strings[0])
    numbers = [int.from_bytes(s) for s in strings]
    root: list = [m, [0]]  # leaf: [m, rows]; node: [depth, {byte: child}]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[0] < m:
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
        diff = numbers[i] ^ numbers[node[1][0]]
        if not diff:
            node[1].append(i)
            continue
        common, other = m - (diff.bit_length() + 7) // 8, strings[node[1][0]]
        above, node = None, root
        while node[0] < common:
            above, node = node, node[1][s[node[0]]]
        if node[0] == common:
            node[1][s[common]] = [m, [i]]
        else:
            new = [common, {other[common]: node, s[common]: [m, [i]]}]
            if above is None:
                root = new
            else:
                above[1][s[above[0]]] = new
    order: list[int] = []
    prefix: list[int] = []
    stack = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if node[0] == m:
            prefix += [shared] + [m] * (len(node[1]) - 1)
            order += node[1]
        else:
            kids = [node[1][b] for b in sorted(node[1])]
            stack += [(kid, node[0]) for kid in reversed(kids[1:])]
            stack.append((kids[0], shared))
    return order, prefix


def multikey_quicksort(words: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their first `shallow` symbols, and where in it a row differs from the one before it.

    Every part of more than one row is split three ways, all parts side by side: its rows' symbols are below, at or above
    the median of three of them. The rows at the pivot go on to their next symbol, the others stay at theirs; parts that
    have come to the depth, or to one row, rest.
    """
    n = len(words)
    order, depth, new = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    new[:1] = True
    open_ = np.arange(n)
    while True:
        begin = np.flatnonzero(new[open_])
        size = np.diff(np.append(begin, len(open_)))
        open_ = open_[np.repeat(size > 1, size) & (depth[open_] < shallow)]
        if not len(open_):
            return order, new
        begin = np.flatnonzero(new[open_])
        size = np.diff(np.append(begin, len(open_)))
        rows = order[open_]
        symbol = words[rows, depth[open_]]
        a, b, c = symbol[begin], symbol[begin + size // 2], symbol[begin + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        side = 1 + (symbol > pivot).astype(np.int8) - (symbol < pivot)
        by = np.argsort(3 * np.repeat(np.arange(len(begin)), size) + side, kind="stable")
        order[open_], side = rows[by], side[by]
        depth[open_] += side == 1
        new[open_[1:][side[1:] != side[:-1]]] = True


def sort_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows of a byte matrix, and each one's common prefix with the row before it (0 for the first).

    Deep-shallow: multikey quicksort over SHALLOW symbols of eight bytes, then a blind trie for each group of rows that
    these don't tell apart.
    """
    n, m = rows.shape
    width = -(-m // 8) * 8
    wide = np.zeros((n, width), np.uint8)
    wide[:, :m] = rows
    words = wide.view(">u8").astype(np.uint64)
    levels = min(SHALLOW, width // 8)
    order, new = multikey_quicksort(words, levels)
    prefix = np.zeros(n, np.int64)
    if n > 1:
        differ = words[order[1:], :levels] ^ words[order[:-1], :levels]
        level = np.argmax(differ != 0, axis=1)
        at = differ[np.arange(n - 1), level]
        bits = np.zeros(n - 1, np.int64)
        same = at == 0
        for shift in (32, 16, 8):
            big = at >= np.uint64(1 << shift)
            bits += np.where(big, shift, 0)
            at = np.where(big, at >> np.uint64(shift), at)
        prefix[1:] = np.where(same, 8 * levels, level * 8 + 7 - bits // 8)
    if m > 8 * SHALLOW:
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        tails = np.ascontiguousarray(rows[:, 8 * SHALLOW :])
        for b, k in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            some = order[b : b + k]
            inner, shared = blind_trie([tails[i].tobytes() for i in some])
            order[b : b + k] = some[inner]
            prefix[b + 1 : b + k] = np.array(shared[1:]) + 8 * SHALLOW
    return order, np.minimum(prefix, m)


def mark(gram: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of what the anchors' strings repeat; rows of one gram must all be given, in any order."""
    by = np.lexsort((pos, doc))
    gram, doc, pos, left, right, around = (x[by] for x in (gram, doc, pos, left, right, around))
    n = len(doc)
    sides = []
    first = gram.astype(">i8").view(np.uint8).reshape(n, 8)  # the gram stands for the first bytes of the right side
    for rows in (np.concatenate([first, around[:, SIDE:]], axis=1), around[:, SIDE - 1 :: -1]):
        order, prefix = sort_suffixes(np.ascontiguousarray(rows))
        sides.append((order, prefix))
    low, high = np.full(n, LEAST), np.full(n, -1)
    for reach in range(REACH + 1):
        ok = np.flatnonzero((left >= reach) & (right >= LEAST - reach))
        if len(ok) < 2:
            continue
        classes = []
        for (order, prefix), depth in zip(sides, (8 + SIDE - reach, reach), strict=True):
            c = np.empty(n, np.int64)
            c[order] = np.cumsum(prefix < depth) if depth else 0
            classes.append(c)
        key = (classes[0] * (n + 1) + classes[1])[ok]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        earliest = ok[first[inverse]]
        again = ok[(doc[ok] != doc[earliest]) | (pos[ok] != pos[earliest])]
        low[again] = np.minimum(low[again], reach)
        high[again] = reach
    hit = high >= 0
    # strings through one anchor overlap, so their union is one run
    return doc[hit], (pos - high)[hit], (pos - low + LEAST)[hit]


def _strings(gram: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string hash, doc, start) of every string through the anchors: of its gram, its place in it, and the bytes around."""
    up = np.cumprod(np.full(2 * SIDE, _STEPS[3], np.uint64), dtype=np.uint64)
    total = np.concatenate([np.zeros((len(doc), 1), np.uint64), np.cumsum(_TABLE[around] * up, axis=1, dtype=np.uint64)], axis=1)
    own = mix(gram.view(np.uint64))
    out = []
    for reach in range(REACH + 1):
        ok = (left >= reach) & (right >= LEAST - reach)
        a = SIDE - reach
        h = mix((total[ok, a + SIDE] - total[ok, a]) + own[ok] + np.uint64(reach) * _STEPS[4])
        out.append((h, doc[ok], pos[ok] - reach))
    h, d, p = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, d, p


def marks(rows: DataFrame, most: int = 20_000, batch_rows: int = 30_000) -> DataFrame:
    """(string, doc_id, start, end): marks (string null), and the strings of grams that have more than `most` rows."""
    names = ["string", "doc_id", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int64()), pa.array(doc), pa.array(start), pa.array(end)], names=names)

        def resolve(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            gram = part[0]
            common = np.bincount(np.unique(gram, return_inverse=True)[1])
            if common.max() == 1:
                return out(*(np.zeros(0, np.int64),) * 3)
            return out(*mark(*part))

        def postpone(part: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(part[0]), 2000):
                h, doc, pos = _strings(*(x[a : a + 2000] for x in part))
                order = np.lexsort((pos, doc, h))
                h, doc, pos = h[order], doc[order], pos[order]
                same = np.concatenate([[False], h[1:] == h[:-1]])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
                again = same & ((doc != doc[head]) | (pos != pos[head]))
                yield out(doc[again], pos[again], pos[again] + LEAST)
                yield pa.RecordBatch.from_arrays([pa.array(h[~same].view(np.int64)), pa.array(doc[~same]), pa.array(pos[~same]), pa.array(pos[~same] + LEAST)], names=names)

        held: tuple[np.ndarray, ...] | None = None
        hot = None  # the gram whose rows are being postponed
        for batch in batches:
            whole = np.array(batch.column(5).is_valid().to_pylist(), bool)
            cols = [batch.column(i).to_numpy() for i in range(5)]
            if not whole.all():
                done = [c[~whole] for c in cols]
                yield out(done[1], done[2], done[2] + done[4])
                cols = [c[whole] for c in cols]
            if not len(cols[0]):
                continue
            around = np.frombuffer(b"".join(batch.column(5).drop_null().to_pylist()), np.uint8).reshape(-1, 2 * SIDE)
            now = (*(c.astype(np.int64) for c in cols), around)
            if hot is not None:
                mine = now[0] == hot
                if mine.any():
                    yield from postpone(tuple(x[mine] for x in now))
                    now = tuple(x[~mine] for x in now)
                if not len(now[0]):
                    continue
                hot = None
            held = now if held is None else tuple(np.concatenate([a, b]) for a, b in zip(held, now, strict=True))
            if len(held[0]) < batch_rows:
                continue
            last = held[0] == held[0][-1]  # sorted by gram: only the last may go on
            if (~last).any():
                yield from _resolve_or_postpone(tuple(x[~last] for x in held), most, resolve, postpone)
            held = tuple(x[last] for x in held)
            if len(held[0]) > most:
                hot = held[0][0]
                yield from postpone(held)
                held = None
        if held is not None and len(held[0]):
            yield from _resolve_or_postpone(held, most, resolve, postpone)

    dealt = rows.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(lean(run), "string long, doc_id long, start long, end long")


def _resolve_or_postpone(part, most, resolve, postpone) -> Iterator[pa.RecordBatch]:
    _, inverse, count = np.unique(part[0], return_inverse=True, return_counts=True)
    big = count[inverse] > most
    if big.any():
        yield from postpone(tuple(x[big] for x in part))
        part = tuple(x[~big] for x in part)
    if len(part[0]):
        yield resolve(part)


def later_strings(found: DataFrame) -> DataFrame:
    """(doc_id, start, end): the marks, and all but the earliest place of each string; streams over runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            done = batch.filter(pc.is_null(batch.column(0)))
            yield pa.RecordBatch.from_arrays(done.columns[1:], names=["doc_id", "start", "end"])
            batch = batch.filter(pc.is_valid(batch.column(0)))
            if not batch.num_rows:
                continue
            string, doc, start, end = (batch.column(i).to_numpy() for i in range(4))
            first = np.concatenate([[head is None or head[0] != string[0]], string[1:] != string[:-1]])
            at = np.maximum.accumulate(np.where(first, np.arange(len(string)), -1))
            hd, hs = np.where(at >= 0, doc[at], head[1] if head else 0), np.where(at >= 0, start[at], head[2] if head else 0)
            again = (doc != hd) | (start != hs)
            yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(start[again]), pa.array(end[again])], names=["doc_id", "start", "end"])
            head = (string[-1], hd[-1], hs[-1])

    dealt = found.repartition(F.coalesce("string", F.xxhash64("doc_id", "start"))).sortWithinPartitions("string", "doc_id", "start")
    return dealt.select("string", "doc_id", "start", "end").mapInArrow(lean(run), "doc_id long, start long, end long")


# --- the operator -----------------------------------------------------------------------------------------------


def copies(docs: DataFrame, most_hot: int = 4096) -> DataFrame:
    """doc_id of the documents of LEAST bytes or more whose whole text an earlier one has.

    Texts are told apart by length and SHA-256, so only these are shuffled. Keys that more than 1 in most_hot rows
    share (and more than 1000 rows) are at most most_hot; their heads are sent to every task, so no task gets all their
    copies.
    """
    keys = docs.filter(F.octet_length("text") >= LEAST).select("doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    same = ["size", "sha"]
    heads = cut(keys.groupBy(*same).agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("head < last").drop("last"))
    rows = heads.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(heads.filter(F.col("n") > max(1000, rows // most_hot)).select(*same, F.col("head").alias("hot")))
    known = keys.join(hot, same, "left")
    rest = known.filter("hot IS NULL").drop("hot").join(heads.select(*same, "head"), same).filter("doc_id > head")
    return known.filter("doc_id > hot").select("doc_id").union(rest.select("doc_id")).distinct()


def repeats(docs: DataFrame, again: DataFrame) -> DataFrame:
    """(doc_id, marks array<struct<start, end>>) of the documents with repeated strings, other than whole copies.

    docs has doc_id and text as bytes; again has the doc_id of the copies, which need no search.
    """
    kept = cut(repeated(anchors(docs.join(again, "doc_id", "left_anti"))))
    found = later_strings(marks(surroundings(docs, kept)))
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("marks"))


def dedup(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Remove every byte that a 100-byte string covers which also starts earlier in the table.

    Returns `keep` columns, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_text (their whole
    characters) and kept_sha256 for each row. Order
    is by doc_id, then position; strings are judged on the input and never cross documents. A null text counts as
    empty, and texts under 100 bytes stay whole. Rows with a null doc_id come first, in the order of their texts' hashes;
    those with equal texts are one document. Rows that share a doc_id are one document, too, whose removed places each
    of them loses; so they should share their text. Long texts are cut for the search, and no string is lost by that. An
    empty table gives an empty result. `keep` must not name a column that is returned anyway.
    """
    free_shuffles(docs.sparkSession)
    keep = keep if keep is not None else ["doc_id"]
    clash = {"n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256"} & set(keep)
    if clash:
        raise ValueError(f"columns that clash with those of the result: {sorted(clash)}")
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    place = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(data), 2) + F.lit(-(1 << 63)))  # below -(1 << 62)
    slim = docs.select(place.alias("doc_id"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("text"))
    again = cut(copies(slim))
    found = repeats(slim, again)
    others = [c for c in keep if c not in ("doc_id", "text")]
    whole = docs.select(place.alias("doc_id"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("text"), *others)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields if f.name in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *others, "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256"]
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                parts, at, n_spans, until = [], 0, 0, -1
                for span in sorted((s["start"], min(s["end"], len(text))) for s in spans or ()):
                    if span[0] > until:
                        parts.append(text[at : span[0]])
                        n_spans += 1
                    at = until = max(until, span[1])
                parts.append(text[at:])
                kept = b"".join(parts)
                rows.append((len(text), len(text) - len(kept), n_spans, kept, "".join(p.decode("utf-8", "ignore") for p in parts), hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:-1], *made], names=names)

    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
    joined = whole.join(found, "doc_id", "left").join(again.withColumn("_copy", F.lit(True)), "doc_id", "left")
    joined = joined.select("doc_id", "text", *others, F.when(F.col("_copy"), everything).otherwise(F.col("marks")).alias("marks"))
    done = joined.mapInArrow(lean(run), "doc_id long, " + (fields + ", " if fields else "") + "n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, kept_sha256 string")
    return done.withColumn("doc_id", F.when(F.col("doc_id") >= -(1 << 62), F.col("doc_id")))

"""Exact n-gram Jaccard join and its components, through a token-group matrix.

1. Texts with equal shingle sets are one class. The most frequent shingles (a bounded list) are ordered last, all
   others by hash; a class's prefix is so long that two linked classes share a shingle of their prefixes.
2. Classes that share a prefix shingle meet. In small meetings all pairs whose sizes and positions allow a link are
   compared; in large ones the rest are compared with the meeting's first class. Linked classes form groups.
3. The token-group matrix holds each group's token union. In large meetings a class (the query) that allows a link
   with a class of another group is matched with that group: the number of its tokens in the group's union bounds its
   overlap with every member, and only groups that reach the least overlap are opened and their members compared.
4. Every link lies within a component. The classes of large meetings are dealt to blocks by component and size, each two
   blocks that allow a link meet once, and a task adds up each class's links; pairs are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractscope.llm.frames import cut, free_shuffles, lean
from contractscope.llm.graph import components
from contractscope.llm.shingles import chunks, mix, shingle_sets

SMALL = 16
#: log2 of the fewest buckets of a sketch.
LEAST_LEVEL = 4
#: log2 of the bits of a group's token union for each bucket of its members' sketches.
BITS = 4
#: Bits of the filter that spares most unneeded texts the way to their join; fixed, so it can be sent to every task.
FILTER_BITS = 1 << 23
#: Tokens of the sets that are compared with a block at once.
AT_ONCE = 1 << 13
#: Parts that a hot token's rows are dealt to, and the most tokens that count as hot, whatever the number of rows.
PARTS, MOST_HOT = 8, 4096
_PAIR = "a long, b long, na int, nb int, token long, pos int, large boolean"


def _name(s: np.ndarray) -> int:
    """64-bit name of a set; the chance that two of n sets share one is about n * n / 2**65."""
    return int(mix(np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sketch(s: np.ndarray) -> bytes:
    """Counts of the set's shingles in 2**level buckets, one or two in each on average; a full byte stands for any higher count."""
    level = max(LEAST_LEVEL, (len(s) // 2).bit_length())
    return np.minimum(np.bincount((s & np.uint64((1 << level) - 1)).astype(np.int64), minlength=1 << level), 255).astype(np.uint8).tobytes()


#: The level of a sketch in SQL, from the size of its set.
_LEVEL = f"greatest({LEAST_LEVEL}, length(bin(%s div 2)))"


def _room(x: list[bytes], y: list[bytes], least: np.ndarray) -> np.ndarray:
    """The most that the overlap of two sets can be, by their sketches (by `least` alone where a byte is full in both)."""
    out = np.empty(len(x), np.int64)
    sizes = np.array([[len(a), len(b)] for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    for la, lb in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes[:, 0] == la) & (sizes[:, 1] == lb))
        width = min(la, lb)
        for k in range(0, len(at), max(1, (1 << 22) // max(la, lb))):
            some = at[k : k + max(1, (1 << 22) // max(la, lb))]
            # the larger sketch is folded to the buckets of the smaller one
            a, b = (np.frombuffer(b"".join([z[i] for i in some]), np.uint8).reshape(len(some), -1, width) for z in (x, y))
            full = (a == 255).any(axis=1) & (b == 255).any(axis=1)
            both = np.minimum(a.sum(axis=1, dtype=np.int32), b.sum(axis=1, dtype=np.int32)).sum(axis=1, dtype=np.int64)
            out[some] = np.where(full.any(axis=1), least[some], both)
    return np.minimum(out, least)


def _sets(batch: pa.RecordBatch, i: int, width: int) -> Iterator[np.ndarray]:
    texts = batch.column(i).to_pylist()
    for a, b in chunks(texts):
        yield from shingle_sets(texts[a:b], width)


def describe(docs: DataFrame, width: int = 5, window: int = 1_500_000) -> DataFrame:
    """(doc_id, n, set, sketch, token, times): a row for each document, and rows for shingles met again within a task's window.

    A set's sketch stands in the first of its rows that a task meets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "set", "sketch", "token", "times"]
        held, size, met = [], 0, set()

        def frequent() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            token, times = token[times > 1].view(np.int64), times[times > 1]
            none = lambda t: pa.nulls(len(token), t)
            return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.binary()), pa.array(token), pa.array(times, pa.int64())], names=names)

        for batch in batches:
            ns, sets, sketches = [], [], []
            for s in _sets(batch, 1, width):
                ns.append(len(s))
                sets.append(_name(s))
                new = sets[-1] not in met
                sketches.append(_sketch(s) if new else None)
                if new:
                    met.add(sets[-1])
                    held.append(s)
                    size += len(s)
            none = lambda t, k=batch.num_rows: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), pa.array(sets, pa.int64()), pa.array(sketches, pa.binary()), none(pa.int64()), none(pa.int64())], names=names)
            if size > window:
                yield frequent()
                held, size, met = [], 0, set()
        if held:
            yield frequent()

    return docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(lean(run), "doc_id long, n int, set long, sketch binary, token long, times long")


def prefixes(docs: DataFrame, last: np.ndarray, percent: int = 75, width: int = 5) -> DataFrame:
    """(token, set, n, pos): the prefix of every document's set; a task repeats no set within its last ones."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(last.view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, met = shared.value, set()
        for batch in batches:
            tokens, sets, ns = [], [], []
            if len(met) > 100_000:
                met = set()
            for s in _sets(batch, 0, width):
                name = _name(s) if len(s) else 0
                if not len(s) or name in met:
                    continue
                met.add(name)
                keep = len(s) - (percent * len(s) + 99) // 100 + 1
                if len(late):
                    at = np.searchsorted(late, s)
                    is_late = late[np.minimum(at, len(late) - 1)] == s
                    s_ = np.concatenate([s[~is_late], s[is_late]])
                else:
                    s_ = s
                tokens.append(s_[:keep].view(np.int64))
                sets.append(name)
                ns.append(len(s))
            if not tokens:
                continue
            size = np.array([len(t) for t in tokens])
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in size])
            columns = [np.concatenate(tokens), np.repeat(np.array(sets, np.int64), size), np.repeat(np.array(ns, np.int32), size), pos]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "set", "n", "pos"])

    return docs.select(F.encode("text", "UTF-8").alias("text")).mapInArrow(lean(run), "token long, set long, n int, pos int")


def _allowed(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes, and what stands from the shared token on, leave room for a link."""
    least = np.minimum(na - pa_, nb - pb).astype(np.int64)
    return (100 * np.minimum(na, nb).astype(np.int64) >= percent * np.maximum(na, nb)) & ((100 + percent) * least >= percent * (na.astype(np.int64) + nb))


def meetings(rows: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs to compare, from prefix rows; for large meetings also their rows (b null), for the matrix.

    Rows are dealt by token and sorted by position, so a meeting is a run in a sorted stream. A task keeps the first
    few rows of a run only, whatever its length: later ones are paired with the first row as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, length = np.zeros((4, 0), np.int64), 0  # the first rows of the open run, and its length so far

        def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            if parts:
                a, b, na, nb, t, p, large = (np.concatenate(x) for x in zip(*parts, strict=True))
                swap = (b < a) & ~large
                a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
                row = pa.array(large)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=large), pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32), mask=large), pa.array(t), pa.array(p.astype(np.int32)), row], names=["a", "b", "na", "nb", "token", "pos", "large"])

        def pairs(x: np.ndarray, y: np.ndarray) -> tuple:
            ok = (x[1] != y[1]) & _allowed(x[2], y[2], x[3], y[3], percent)
            x, y = x[:, ok], y[:, ok]
            return x[1], y[1], x[2], y[2], x[0], x[3], np.zeros(len(x[0]), bool)

        def rows_of(x: np.ndarray) -> tuple:
            return x[1], x[1], x[2], x[2], x[0], x[3], np.ones(len(x[0]), bool)

        for batch in batches:
            now = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            if not now.shape[1]:
                continue
            out: list[tuple] = []
            start = np.flatnonzero(np.concatenate([[True], now[0, 1:] != now[0, :-1]]))
            stop = np.append(start[1:], now.shape[1])
            if length and now[0, 0] != kept[0, 0]:
                kept, length = kept[:, :0], 0
            two = (stop - start == 2) & (np.arange(len(start)) > 0)
            two[-1] = False
            out.append(pairs(now[:, start[two]], now[:, start[two] + 1]))
            for i in np.flatnonzero((stop - start > 2) | (np.arange(len(start)) == 0) | (np.arange(len(start)) == len(start) - 1)):
                part = now[:, start[i] : stop[i]]
                if i or not length:
                    kept, length = part[:, :0], 0
                room = max(0, SMALL - kept.shape[1])
                first, later = part[:, :room], part[:, room:]
                if first.shape[1]:
                    both = np.concatenate([kept, first], axis=1)
                    x, y = np.triu_indices(both.shape[1], 1)
                    new = y >= kept.shape[1]
                    out.append(pairs(both[:, x[new]], both[:, y[new]]))
                    kept = both
                if later.shape[1]:
                    out.append(pairs(np.repeat(kept[:, :1], later.shape[1], axis=1), later))
                    out.append(rows_of(later if length > SMALL else np.concatenate([kept, later], axis=1)))
                length += part.shape[1]
            yield from flush(out)

    dealt = rows.repartition("token").sortWithinPartitions("token", "pos", "n", "set")
    return dealt.mapInArrow(lean(run), _PAIR)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int = 5) -> DataFrame:
    """(set, tokens) of the classes in wanted (doc_id, set), from the texts of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, lists = [], []
            for i, (s, want) in enumerate(zip(_sets(batch, 1, width), batch.column(0).to_pylist(), strict=True)):
                if _name(s) == want:
                    keep.append(i)
                    lists.append(s.view(np.int64))
            ends = np.cumsum([0] + [len(x) for x in lists])
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), values], names=["set", "tokens"])

    # a merge join keeps the two Python steps in two stages, so a task has one Python worker at a time
    texts = _sifted(docs.select("doc_id", F.encode("text", "UTF-8").alias("text")), wanted).join(wanted.hint("merge"), "doc_id").select("set", "text")
    return texts.mapInArrow(lean(run), "set long, tokens array<long>").dropDuplicates(["set"])


def _sifted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows and a few more: a bit filter of fixed size drops most others before they are shuffled."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit")
    words = wanted.select(place).groupBy(F.expr("cast(bit div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():  # at most FILTER_BITS / 64 rows, whatever is wanted
        filled[r["word"]] = r["bits"]
    shared = texts.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy()
            hit = shared.value[bit >> 6].view(np.uint64) >> (bit & 63).astype(np.uint64) & np.uint64(1)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["doc_id", "text"]).filter(pa.array(hit == 1))

    return texts.select("doc_id", "text", place).mapInArrow(lean(run), "doc_id long, text binary")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches leave room for a link: the smaller counts of all buckets bound the overlap from above."""
    sketches = classes.select("set", "sketch")
    both = pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            most = _room(batch.column(4).to_pylist(), batch.column(5).to_pylist(), np.minimum(na, nb))
            ok = (100 + percent) * most >= percent * (na + nb)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(ok))

    return both.mapInArrow(lean(run), "a long, b long, na int, nb int")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""
    left = pairs.join(sets.select(F.col("set").alias("a"), F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("set").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.withColumn("_i", common).filter(f"{100 + percent} * cast(_i as long) >= {percent} * (cast(na as long) + nb)").select("a", "b")


def frequent(seen: DataFrame, most: int, least: int = 8) -> np.ndarray:
    """At most `most` of the shingles met most often, and at least `least` times, whatever the number of documents."""
    times = F.sum("times").alias("times")
    counted = cut(seen.filter("token IS NOT NULL").groupBy("token").agg(times).filter(F.col("times") >= least).select("token", F.floor(16 * F.log2("times")).cast("int").alias("step")))
    chosen, n = 1 << 30, 0
    for step, k in sorted(((r["step"], r["count"]) for r in counted.groupBy("step").count().collect()), reverse=True):  # 16 rows for each doubling
        if n + k > most:
            break
        chosen, n = step, n + k
    return counted.filter(F.col("step") >= chosen).select("token").toArrow().column(0).to_numpy()


def similar(docs: DataFrame, percent: int = 75, width: int = 5, most_last: int = 1 << 20, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    component_id is the smallest doc_id that links reach; n_links counts all links from a document's class to other
    classes, whose copies are not expanded, and is left out without count_links. Null, empty and blank texts have no shingles and are alone. The list
    of shingles ordered last has at most `most_last` entries, whatever the number of documents; it only sets the order.
    """
    free_shuffles(docs.sparkSession)
    seen = cut(describe(docs, width))
    whole = seen.filter("n IS NOT NULL").select("doc_id", "n", "set")
    last = frequent(seen, most_last).astype(np.int64)
    classes = cut(seen.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")))

    met = cut(meetings(prefixes(docs, last, percent, width), percent))
    pairs = met.filter("NOT large").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = cut(plausible(pairs, classes, percent))
    large = not met.filter("large").isEmpty()
    rows = met.filter("large").select("token", F.col("a").alias("set"), F.col("na").alias("n"), "pos").distinct()
    named_docs = classes.select("doc_id", "set")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    sets = cut(sets_of(docs, named_docs.join(nodes, "set").select("doc_id", "set"), width))
    links = cut(verified(pairs, sets, percent))
    if large:
        more, more_sets = _through_groups(docs, rows, links, classes, percent, width)
        links = cut(links.union(more).distinct())
    named = classes.select(F.col("set").alias("a"), F.col("doc_id").alias("da"))
    by_doc = links.join(named, "a").join(named.toDF("b", "db"), "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    found = components(by_doc)
    of_class = classes.join(found, F.col("doc_id") == F.col("node"), "left").select("set", F.coalesce("component", "doc_id").alias("component_id"))
    if count_links:
        if large:
            sets = sets.union(more_sets.join(sets.select("set"), "set", "left_anti"))
            degree = _degrees(links, rows, sets, classes.join(found, F.col("doc_id") == F.col("node")).select("set", F.col("component").alias("g")), percent)
        else:
            degree = links.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("n_links"))
        of_class = of_class.join(degree, "set", "left")
    out = whole.join(of_class, "set", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    counts = [F.when(F.col("n") == 0, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links")] if count_links else []
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component, *counts)


def _row_of_counts(sketch: bytes, level: int) -> np.ndarray:
    return np.frombuffer(sketch, np.uint8)


def _bits(tokens: list[int] | np.ndarray, level: int) -> np.ndarray:
    return (np.asarray(tokens, np.int64) & ((1 << level + BITS) - 1)).astype(np.int64)


def _row_of_bits(tokens: list[int], level: int) -> np.ndarray:
    row = np.zeros(1 << level + BITS, bool)
    row[_bits(tokens, level)] = True
    return np.packbits(row, bitorder="little")


def _merged(rows: DataFrame, kind: str) -> DataFrame:
    """(h, level, sh array<binary>): one row of the matrix for each group and level, from rows (g, level, value).

    Each task's rows are reduced before they meet by group, so that a group of any size sends a row for each task at
    most. sh has one part, or a few where a task's store was full.
    """
    make, merge = {"counts": (_row_of_counts, np.maximum), "bits": (_row_of_bits, np.bitwise_or)}[kind]

    def reduced(part: DataFrame, most_bytes: int, first) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            size = 0

            def flush() -> pa.RecordBatch:
                keys = list(held)
                return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())], names=["h", "level", "sh"])

            for batch in batches:
                groups, levels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, key in enumerate(zip(groups, levels, strict=True)):
                    value = batch.column(2)[i]
                    row = first(value.values.to_numpy() if pa.types.is_list(value.type) else value.as_py(), key[1])
                    if key in held:
                        merge(held[key], row, out=held[key])
                        continue
                    if size and size + len(row) > most_bytes:
                        yield flush()
                        held, size = {}, 0
                    held[key] = row.copy()
                    size += len(row)
            if held:
                yield flush()

        return part.mapInArrow(lean(run), "h long, level int, sh binary")

    met = reduced(rows, 1 << 25, make).repartition("h", "level").sortWithinPartitions("h", "level")
    return reduced(met, 1 << 22, _row_of_counts).groupBy("h", "level").agg(F.collect_list("sh").alias("sh"))


def _one_row(parts: list[bytes], merge: np.ufunc) -> bytes:
    return parts[0] if len(parts) == 1 else merge.reduce([np.frombuffer(q, np.uint8) for q in parts], axis=0).tobytes()


def _group_plausible(asked: DataFrame, member: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The queries (set, h, level, n, m) for which the buckets of the group h leave room for a link with some member of that level."""
    sketches = classes.select("set", "sketch")
    needed = member.join(asked.select(F.col("h").alias("g"), "level").distinct(), ["g", "level"]).join(sketches, "set").select("g", "level", "sketch")
    both = asked.join(sketches, "set").join(_merged(needed, "counts"), ["h", "level"]).select("set", "h", "level", "n", "m", "sketch", "sh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 4))
            most = _room(batch.column(5).to_pylist(), [_one_row(p, np.maximum) for p in batch.column(6).to_pylist()], n)
            yield pa.RecordBatch.from_arrays(batch.columns[:5], names=["set", "h", "level", "n", "m"]).filter(pa.array((100 + percent) * most >= percent * (n + m)))

    return both.mapInArrow(lean(run), "set long, h long, level int, n int, m int")


def _qualifying(asked: DataFrame, member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(set, h) of the queries whose tokens in the token union of the group h leave room for a link.

    A union is held as bits, so it has a fixed size for each level, however many members a group has; tokens that share
    a bit can only raise the bound.
    """
    unions = _merged(member.join(sets, "set").select("g", "level", "tokens"), "bits")
    both = asked.join(sets, "set").join(unions, ["h", "level"]).select("set", "h", "level", "n", "m", "tokens", "sh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 4))
            most = np.empty(len(n), np.int64)
            for i, (level, parts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(6).to_pylist(), strict=True)):
                at = _bits(batch.column(5)[i].values.to_numpy(), level)
                union = np.frombuffer(_one_row(parts, np.bitwise_or), np.uint8)
                most[i] = (union[at >> 3] >> (at & 7).astype(np.uint8) & 1).sum()
            ok = (100 + percent) * np.minimum(most, n) >= percent * (n + m)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["set", "h"]).filter(pa.array(ok))

    return both.mapInArrow(lean(run), "set long, h long").distinct()


def _dealt(rows: DataFrame, hot: DataFrame, by: str, own: str, other: str) -> DataFrame:
    """Rows with the numbers of the blocks in which they meet: one block for a token, but PARTS x PARTS blocks for a hot one.

    A hot token's rows are dealt to PARTS parts by a hash, and each goes to every part of the other side once.
    """
    part = F.expr(f"cast(if(hot, pmod(xxhash64({by}), {PARTS}), 0) as int)").alias(own)
    every = F.explode(F.expr(f"if(hot, sequence(0, {PARTS - 1}), array(0))")).alias(other)
    return rows.join(hot, "token", "left").select(*rows.columns, part, every)


def _through_groups(docs: DataFrame, rows: DataFrame, links: DataFrame, classes: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Links between different groups, from the rows of large meetings, by the token-group matrix; and the sets it met."""
    groups = components(links)
    own = cut(rows.join(groups.withColumnRenamed("node", "set"), "set", "left").select("token", "set", "n", "pos", F.coalesce("component", "set").alias("g")))
    # what a group's members in a meeting allow at most, by their sizes: one row per meeting, group and size
    kinds = own.groupBy("token", "g", "n").agg(F.min("pos").alias("pos")).toDF("token", "h", "m", "at")
    several = cut(own.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("rows")).filter("g0 <> g1").select("token", "rows"))
    hot = F.broadcast(several.filter(F.col("rows") > max(512, own.count() // MOST_HOT)).select("token", F.lit(True).alias("hot")))  # at most MOST_HOT rows
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m) AND {100 + percent} * least(n - pos, m - at) >= {percent} * (n + m)"
    asked = _dealt(own, hot, "set", "i", "j").join(_dealt(kinds, hot, "h, m", "j", "i"), ["token", "i", "j"]).filter("g <> h").filter(fits)
    asked = cut(asked.groupBy("set", "h", F.expr(_LEVEL % "m").alias("level")).agg(F.first("n").alias("n"), F.min("m").alias("m")))
    # the matrix, first by buckets: a group has a row for each level of its members' sketches, with their greatest counts
    inside = own.select("set", "g", F.expr(_LEVEL % "n").alias("level")).distinct()
    asked = cut(_group_plausible(asked, inside, classes, percent))
    # then by the tokens themselves
    member = inside.join(asked.select(F.col("h").alias("g"), "level").distinct(), ["g", "level"])
    wanted = member.select("set").union(asked.select("set")).distinct()
    sets = cut(sets_of(docs, classes.join(wanted, "set").select("doc_id", "set"), width))
    opened = cut(_qualifying(asked, member, sets, percent))
    # open them: members that met the query in a way that allows a link
    within = own.select("token", F.col("set").alias("y"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("g").alias("h"))
    asking = own.join(opened, "set").select("token", "set", "n", "pos", "h")
    pairs = _dealt(asking, hot, "set", "i", "j").join(_dealt(within, hot, "y", "j", "i"), ["token", "h", "i", "j"]).filter(fits)
    tidy = pairs.select(F.least("set", "y").alias("a"), F.greatest("set", "y").alias("b"), F.when(F.col("set") < F.col("y"), F.col("n")).otherwise(F.col("m")).alias("na"), F.when(F.col("set") < F.col("y"), F.col("m")).otherwise(F.col("n")).alias("nb"))
    return verified(plausible(tidy.distinct(), classes, percent), sets, percent), sets


def _degrees(links: DataFrame, rows: DataFrame, sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(set, n_links): each linked class's number of links, from the links, the rows of large meetings and (set, g).

    A link that no small meeting found has both ends in large meetings. Such pairs are counted by blocks; the others
    are all in links.
    """
    members = cut(rows.select("set", "n").distinct().join(groups, "set"))
    met = members.select("set", F.lit(True).alias("met"))
    apart = links.join(met.toDF("a", "ma"), "a", "left").join(met.toDF("b", "mb"), "b", "left").filter("ma IS NULL OR mb IS NULL")
    ones = apart.select(F.explode(F.array("a", "b")).alias("set"), F.lit(1).cast("long").alias("n_links"))
    return ones.union(_counted(members, sets, percent)).groupBy("set").agg(F.sum("n_links").alias("n_links"))


class _Block:
    """Sets by their tokens: those of many sets as a matrix, the others as postings."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.start, self.times = np.unique(tokens[order], return_index=True, return_counts=True)
        self.of = np.repeat(np.arange(len(sets)), self.sizes)[order]
        many = np.flatnonzero(8 * self.times > len(sets))  # at most eight times as many as a set has on average
        self.column = np.full(len(self.tokens), -1)
        self.column[many] = np.arange(len(many))
        self.matrix = np.zeros((len(sets), len(many)), np.float32)
        column = np.repeat(self.column, self.times)
        self.matrix[self.of[column >= 0], column[column >= 0]] = 1

    def linked(self, sets: list[np.ndarray], percent: int) -> np.ndarray:
        """Whether each of the sets (a row) is linked with each of the block's."""
        sizes = np.array([len(s) for s in sets], np.int64)
        tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        hit = self.tokens[at] == tokens
        of, at = of[hit], at[hit]
        column = self.column[at]
        there = np.zeros((len(sets), self.matrix.shape[1]), np.float32)
        there[of[column >= 0], column[column >= 0]] = 1
        both = np.rint(there @ self.matrix.T).astype(np.int64)
        of, at = of[column < 0], at[column < 0]
        if len(at):
            times = self.times[at]
            ends = np.cumsum(times)
            x = self.of[np.arange(ends[-1]) + np.repeat(self.start[at] - ends + times, times)]
            both += np.bincount(np.repeat(of, times) * len(self.sizes) + x, minlength=both.size).reshape(both.shape)
        return (100 + percent) * both >= percent * (sizes[:, None] + self.sizes)


def _counted(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(set, n_links): links of the members (set, n, g) with others of the same g, in parts that are to be added up.

    Linked sizes lie in one band or in neighbouring ones. A component's band has up to eight blocks of 256 members or
    more, and beyond that blocks of about 4096 members or 2**20 tokens at most. Two blocks meet in one task, which holds
    the first and takes the second as a stream.
    """
    banded = members.withColumn("band", F.floor(F.log("n") / (math.log(100 / percent) + 1e-3)).cast("int"))
    many = F.ceil(F.greatest(F.least(F.lit(8.0), F.count("*") / 256), F.count("*") / 4096, F.sum("n") / (1 << 20))).cast("int")
    kinds = cut(banded.groupBy("g", "band").agg(many.alias("k"), F.count("*").alias("c")))
    up, down = (kinds.select("g", (F.col("band") - d).alias("band"), F.col("k").alias(k)) for d, k in ((1, "k_up"), (-1, "k_down")))
    kinds = kinds.join(up, ["g", "band"], "left").join(down, ["g", "band"], "left").filter("c > 1 OR k_up IS NOT NULL OR k_down IS NOT NULL").drop("c")
    placed = banded.join(kinds, ["g", "band"]).withColumn("i", F.expr("cast(pmod(xxhash64(set, 7), k) as int)"))
    meets = """concat(
        transform(sequence(0, k - 1), j -> named_struct('band', band, 'x', least(i, j), 'other', band, 'y', greatest(i, j), 'side', if(i <= j, 0, 1))),
        if(k_up IS NULL, array(), transform(sequence(0, k_up - 1), j -> named_struct('band', band, 'x', i, 'other', band + 1, 'y', j, 'side', 0))),
        if(k_down IS NULL, array(), transform(sequence(0, k_down - 1), j -> named_struct('band', band - 1, 'x', j, 'other', band, 'y', i, 'side', 1))))"""
    keys = ["g", "band", "x", "other", "y"]
    dealt = sets.join(placed.select("set", "g", F.expr(meets).alias("meets")), "set").select("set", "tokens", "g", F.inline("meets")).select(*keys, "side", "set", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, held, block, found = None, [], [], None, np.zeros(0, np.int64)

        def batch_of(sets: list[int], n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(n, pa.int64())], names=["set", "n_links"])

        def portions(sets: list[np.ndarray]) -> Iterator[slice]:
            a, size = 0, 0
            for b, s in enumerate(sets):
                if b > a and size + len(s) > AT_ONCE:
                    yield slice(a, b)
                    a, size = b, 0
                size += len(s)
            if sets:
                yield slice(a, len(sets))

        def end() -> Iterator[pa.RecordBatch]:
            if key is not None and key[1:3] == key[3:] and len(held) > 1:
                whole = _Block(held)
                for at in portions(held):
                    yield batch_of(names[at], whole.linked(held[at], percent).sum(axis=1) - 1)
            elif block is not None:
                yield batch_of(names, found)

        for batch in batches:
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True))
            a = 0
            while a < len(rows):
                b = a
                while b < len(rows) and rows[b][:6] == rows[a][:6]:
                    b += 1
                if rows[a][:5] != key:
                    yield from end()
                    key, names, held, block = rows[a][:5], [], [], None
                some = [batch.column(7)[i].values.to_numpy() for i in range(a, b)]
                if rows[a][5] == 0:
                    names += [r[6] for r in rows[a:b]]
                    held += some
                elif held:
                    if block is None:
                        block, found = _Block(held), np.zeros(len(held), np.int64)
                    for at in portions(some):
                        hit = block.linked(some[at], percent)
                        found += hit.sum(axis=0)
                        yield batch_of([r[6] for r in rows[a:b]][at], hit.sum(axis=1))
                a = b
        yield from end()

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(lean(run), "set long, n_links long")

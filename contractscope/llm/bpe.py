"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs tells which merge comes next.

A leaf holds the rank of the pair that begins at its symbol, with the place in its low bits, so the root is the leftmost
pair of lowest rank. A merge changes three leaves; each change climbs to the root. Short words of one width are merged
side by side, one tree a row; long ones have a tree of their own. A word's ids are kept in a table of bounded size, so
that a worker merges a word again only after the table was emptied.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractscope.llm.frames import WordTable, gathered, lean, ragged

#: What the normaliser and the pattern take for white space.
_WHITE = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NONE = -1


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it can be seen, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        out[b], free = (chr(b), free) if b in seen else (chr(free), free + 1)
    return out


class Merges:
    """The merges of a tokenizer: ranks and results of pairs, and the trees that apply them."""

    def __init__(self, pairs: list[tuple[int, int, int]], widths: tuple[int, ...] = (4, 8, 16, 32, 64)):
        """pairs: (left id, right id, merged id) by rank."""
        self.widths = widths
        self.rank = {(a, b): (r, m) for r, (a, b, m) in enumerate(pairs)}
        key = np.array([(a << 32) | b for a, b, _ in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = np.append(key[order], np.iinfo(np.int64).max), np.append(order, -1).astype(np.int64)
        self.merged = np.array([m for _, _, m in pairs], np.int64)

    def _leaf(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Rank times width plus place of each pair of ids; the largest number where the two don't merge."""
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at] * width + place, np.iinfo(np.int64).max)

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, filled up with -1, merged to the end; the number of columns is a power of two.

        Every round takes the root of each row that still has one and updates its three changed leaves.
        """
        n, width = ids.shape
        none = np.iinfo(np.int64).max
        ids = np.column_stack([ids, np.full(n, _NONE, np.int64)]).ravel()  # a column to point at beyond the last
        wide = width + 1
        after = np.tile(np.arange(1, wide + 1), n)
        before = np.tile(np.arange(-1, width), n)
        before[::wide] = width
        at = np.arange(width)
        tree = np.full((n, 2 * width), none)
        by_row = ids.reshape(n, wide)
        tree[:, width:] = self._leaf(by_row[:, :-1], by_row[:, 1:], at, width)
        for level in range(width.bit_length() - 2, -1, -1):
            low = 1 << level
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        tree = tree.ravel()
        rows = np.arange(n)
        while True:
            root = tree[rows * 2 * width + 1]
            some = root < none
            rows, root = rows[some], root[some]
            if not len(rows):
                break
            base, place = rows * wide, root % width
            right = after[base + place]
            beyond = after[base + right]
            left = before[base + place]
            merged = self.merged[root // width]
            ids[base + place], ids[base + right] = merged, _NONE
            after[base + place] = beyond
            before[base + beyond] = place
            follows, precedes = ids[base + beyond], ids[base + left]
            leaves = np.concatenate([self._leaf(merged, follows, place, width), np.full(len(rows), none), self._leaf(precedes, merged, left, width)])
            node = np.concatenate([place, right, left]) + width
            tree_of = np.tile(rows * 2 * width, 3)
            real = node < 2 * width  # a first symbol has no left neighbour
            node, tree_of = node[real], tree_of[real]
            tree[tree_of + node] = leaves[real]
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[tree_of + node] = np.minimum(tree[tree_of + 2 * node], tree[tree_of + 2 * node + 1])
        return ids.reshape(n, wide)[:, :-1]

    def merge_one(self, ids: list[int]) -> list[int]:
        """One sequence of any length, by a tree of its own."""
        n = len(ids)
        width = 1 << max(1, (n - 1).bit_length())
        none = 1 << 62
        tree = [none] * (2 * width)
        rank, ids = self.rank, list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if found := rank.get((ids[i], ids[i + 1])):
                tree[width + i] = found[0] * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:  # nothing changes from here on
                    break
                tree[i] = low
                i >>= 1

        while tree[1] < none:
            r, i = divmod(tree[1], width)
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = int(self.merged[r]), _NONE, k
            found = None
            if k < n:
                before[k] = i
                found = rank.get((ids[i], ids[k]))
            put(j, none)
            put(i, found[0] * width + i if found else none)
            if (h := before[i]) >= 0:
                found = rank.get((ids[h], ids[i]))
                put(h, found[0] * width + h if found else none)
        return [x for x in ids if x != _NONE]

    def merge_all(self, words: list[list[int]]) -> list[np.ndarray]:
        """Each sequence merged to the end."""
        size = np.array([len(w) for w in words], np.int64)
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(words)
        low = 0
        for width in self.widths:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            for a in range(0, len(rows), 20_000):
                some = rows[a : a + 20_000]
                ids = np.full((len(some), width), _NONE, np.int64)
                filled = np.arange(width) < size[some][:, None]
                ids[filled] = np.concatenate([words[i] for i in some])
                ids = self.merge_rows(ids)
                left = ids >= 0
                parts = np.split(ids[left].astype("<u4"), np.cumsum(left.sum(axis=1))[:-1])
                for i, part in zip(some.tolist(), parts, strict=True):
                    out[i] = part
        for i in np.flatnonzero(size > low).tolist():
            out[i] = np.array(self.merge_one(words[i]), "<u4")
        return out


class Codec:
    """Encodes and decodes as a tokenizer's JSON file says: NFC, white space, lower case; a pattern's matches as words;
    bytes as letters; BPE with an end-of-word suffix. Files of other kinds are refused."""

    _kept: dict[str, Codec] = {}

    def __init__(self, path: str, most: int = 250_000, longest: int = 40):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, cut = said["model"], said["pre_tokenizer"] or {}
        steps = [s["type"] for s in (said["normalizer"] or {}).get("normalizers", [])]
        kinds = [s["type"] for s in cut.get("pretokenizers", [])]
        plain = not (model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"))
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or kinds != ["Split", "ByteLevel"] or said["decoder"] is not None or not plain:
            raise ValueError("this codec reads lower-case word BPE files only")
        self.longest, self.most = longest, most
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        letters = byte_letters()
        self.inner = [vocab.get(x, _NONE) for x in letters]
        self.last = [vocab.get(x + suffix, _NONE) for x in letters]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.large_string())
        pattern = next(s["pattern"]["Regex"] for s in cut["pretokenizers"] if s["type"] == "Split").replace(r"[^\s", "[^" + _WHITE[1:-1])
        self.pattern = regex.compile(pattern + r"|\n", regex.V0)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = WordTable(most, longest)
        self.parts: dict[str, bytes] = {"\n": b""}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _symbols(self, part: str) -> list[int]:
        data = part.encode()
        out = [self.inner[b] for b in data]
        out[-1] = self.last[data[-1]]
        return out if _NONE not in out else [x for x in out if x != _NONE]

    def _matches(self, words: list[str]) -> list[str]:
        """The pattern's matches in all words, with a line end after each word's."""
        text = unicodedata.normalize("NFC", "\n".join(words) + "\n")
        return self.pattern.findall(text.replace("\u03a3", "\u03c3").lower())  # letter by letter: no final sigma

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that hold neither white space nor a special token."""
        if not words:
            return []
        if len(self.parts) > self.most:
            self.parts = {"\n": b""}
        found = self._matches(words)
        known = self.parts
        new = list(set(found).difference(known))
        for w, ids in zip(new, self.merges.merge_all([self._symbols(w) for w in new]), strict=True):
            known[w] = ids.tobytes()
        out, now = [], []
        for w in found:
            if w == "\n":
                out.append(known[now[0]] if len(now) == 1 else b"".join([known[x] for x in now]))
                now = []
            else:
                now.append(w)
        for w in new:
            if len(w) > self.longest:
                del known[w]
        return out

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words without ASCII white space; a special token stands for itself wherever it is."""
        if self.specials is None or not any("<" in w for w in words):
            return self._encode_words(words)
        split = [self.specials.split(w) for w in words]
        plain = [x for s in split for x in s[::2]]
        made = iter(self._encode_words(plain))
        out = []
        for s in split:
            ids = [next(made)]
            for token in s[1::2]:
                ids += [np.array([self.special[token]], "<u4").tobytes(), next(made)]
            out.append(b"".join(ids))
        return out

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each whole text; a null text counts as empty."""
        ids, begin = ragged(*self.table.look_up(pc.ascii_split_whitespace(texts.fill_null("")), self._new), "<u4")
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids.view("<i4"), pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list joined by a space; ids that the file lacks are left out, and a null list is null."""
        tokens = pa.ListArray.from_arrays(ids.offsets, self.tokens.take(pc.if_else(pc.and_(pc.greater_equal(ids.values, 0), pc.less(ids.values, len(self.tokens))), ids.values, None)))
        if tokens.values.null_count:
            tokens = pa.array([None if x is None else [t for t in x if t is not None] for x in tokens.to_pylist()], pa.list_(pa.large_string()))
        joined = pc.binary_join(tokens, pa.scalar(" ", pa.large_string()))
        return pc.if_else(ids.is_valid(), joined, None) if ids.null_count else joined


def _with_column(docs: DataFrame, source: str, name: str, kind: str, run) -> DataFrame:
    """docs with one column more, made from `source` batch by batch; an input column of that name is replaced."""
    keep = [c for c in docs.columns if c != name]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("_source"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, len(keep)):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], run(batch.column(len(keep)))], names=[*keep, name])

    return slim.mapInArrow(lean(each), f"{fields}{', ' if fields else ''}`{name}` {kind}")


def encode_and_decode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with both columns in the place of the text, as encode and then decode give them.

    One pass, so that a task has one worker with one set of word tables, where two passes would hold two at once.
    """
    keep = [c for c in docs.columns if c not in (text, ids, decoded)]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_source"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[:-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        for batch in gathered(batches, len(keep), 1 << 22):
            made = codec.encode(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made, codec.decode(made).cast(pa.string())], names=[*keep, ids, decoded])

    return slim.mapInArrow(lean(each), f"{fields}`{ids}` array<int>, `{decoded}` string")


def encode(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with the column `ids`: the tokenizer's ids of each whole text, without special tokens around it.

    A null or empty text has no ids. Special tokens of the file are found inside texts, as the library does. Rows are
    kept as they are, repeated ones too; an empty table gives an empty result; an input column of the new one's name is
    replaced. Narrow: no shuffle. A worker holds one batch of about 8 MB of text (or one text, if longer) and tables of
    at most 250 000 words; a word of any length is merged in n log n steps.
    """
    return _with_column(docs, text, name, "array<int>", lambda texts: Codec.of(tokenizer).encode(texts))


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """docs with the column `decoded`: the text of each list of ids, special tokens included.

    A null list gives null, an empty one an empty text; ids that the file lacks are left out. Otherwise as encode.
    """
    return _with_column(docs, ids, name, "string", lambda lists: Codec.of(tokenizer).decode(lists).cast(pa.string()))

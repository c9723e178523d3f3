"""SentencePiece encoding and decoding by shortest paths in a weighted finite-state transducer.

A model file is compiled into three transducers, whose weights are tropical: they add along a path, the least path wins.

- The normaliser: its states are prefixes of the model's own rewrite rules, and the longest match is rewritten; white
  space becomes the mark U+2581, and a mark is put before the text.
- The pieces: an arc for each character, and an output at each state that ends a piece; a character that is no piece
  leaves by byte fallback, with an arc for each of its UTF-8 bytes.
- The neighbours: in a unigram model one state, and an arc weighs its piece's negative log probability. In a BPE model a
  state for each piece; an arc from one to another has weight 0 if merging their joined text gives just these two
  again, else infinity. A sequence of pieces whose neighbours all pass is the merge result itself, so one path of
  finite weight is left, and each prefix of it is the best path of that prefix.

A text is composed with all three from its begin on, arc by arc, and only states that the text reaches are made. Where no
piece reaches across the start of a mark, words are composed one by one, and their paths are kept in a bounded table.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from contractscope.llm.frames import WordTable, gathered, ragged

MARK = "▁"
#: Kinds of pieces, the field numbers of a model file, and the penalty of unknown characters.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


def rewrite_rules(charsmap: bytes) -> dict[str, str]:
    """The rewrite rules of a model's normaliser, read from its double-array trie."""
    if not charsmap:
        return {}
    size = struct.unpack_from("<I", charsmap)[0]
    units = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist()
    texts = charsmap[4 + size :]
    rules: dict[str, str] = {}
    stack = [(0, b"")]
    while stack:
        node, key = stack.pop()
        base = node ^ ((units[node] >> 10) << ((units[node] & (1 << 9)) >> 6))
        if units[node] >> 8 & 1 and key:
            begin = units[base] & 0x7FFFFFFF
            rules[key.decode("utf-8", "replace")] = texts[begin : texts.index(b"\0", begin)].decode()
        for c in range(1, 256):
            if base ^ c < len(units) and units[base ^ c] & 0x800000FF == c:
                stack.append((base ^ c, key + bytes([c])))
    return rules


def _trie(words: dict[str, str]) -> dict:
    """States as dictionaries from a character to the next state; the empty string stands for a final state's output."""
    start: dict = {}
    for word, out in words.items():
        state = start
        for c in word:
            state = state.setdefault(c, {})
        state[""] = out
    return start


@dataclass
class Transducer:
    """The compiled transducer of one model."""

    ids: dict[str, int]
    score: dict[str, float]
    byte_ids: list[int]
    text_of: list[bytes]
    unk_id: int
    bpe: bool = True
    rules: dict[str, str] = field(default_factory=dict)
    dummy_prefix: bool = True
    one_space: bool = False
    most: int = 400_000

    def __post_init__(self) -> None:
        self.table = WordTable(self.most)
        self.paths: dict[str, bytes] = {}
        self.rewrite = _trie(self.rules)
        self.split: dict[str, tuple[str, str]] = {}
        self.slow: set[str] = set()  # pieces with a part that merges later than the whole
        living = self.ids
        if self.bpe:
            living = {}
            for piece in sorted(self.ids, key=len):
                left, right = self._last_merge(piece)
                if left or len(piece) == 1:
                    living[piece] = self.ids[piece]
                if left:
                    self.split[piece] = left, right
                    if any(x in self.slow or (x in self.split and self.score[x] <= self.score[piece]) for x in (left, right)):
                        self.slow.add(piece)
        self.pieces = _trie({p: p for p in living})
        self.passes: dict[str, dict[str, bool]] = {}
        self.n_passes = 0
        self.unknown = -(min(self.score.values(), default=0.0) - UNKNOWN_PENALTY)
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        # where no piece has a letter beside another character (but for the mark before it), no path leaves a run of letters
        runs = not any(a.isalpha() != b.isalpha() and a != MARK for piece in self.ids for a, b in zip(piece, piece[1:], strict=False))
        self.words = re.compile(rf"{MARK}*[^\W\d_]+|{MARK}*(?:(?![^\W\d_])[^{MARK}])+|{MARK}+" if runs else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        texts = pa.array(self.text_of, pa.large_binary())
        self.outputs = texts

    _kept: ClassVar[dict[str, Transducer]] = {}

    @classmethod
    def of(cls, path: str) -> Transducer:
        """This worker's transducer, whose paths its later tasks find again."""
        if path not in cls._kept:
            with open(path, "rb") as file:
                cls._kept[path] = cls.compile(file.read())
        return cls._kept[path]

    @classmethod
    def compile(cls, model: bytes) -> Transducer:
        """Compile from a model file's bytes: pieces, scores, kind of model, and the normaliser."""
        ids, score, text_of, byte_ids, unk_id = {}, {}, [], {}, 0
        kind, byte_fallback, charsmap, prefix, one_space, suffix = 1, 0, b"", 1, 1, 0
        for number, value in _fields(model):
            if number == 1:
                part = dict(_fields(value))
                piece, i = part[1].decode(), len(text_of)
                what = part.get(3, NORMAL)
                text_of.append(piece.replace(MARK, " ").encode())
                if what == UNKNOWN:
                    unk_id, text_of[i] = i, " ⁇ ".encode()
                elif what == CONTROL:
                    text_of[i] = b""
                elif what == BYTE:
                    byte_ids[int(piece[3:5], 16)] = i
                    text_of[i] = bytes([int(piece[3:5], 16)])
                elif what == USER:
                    raise ValueError("models with user-defined pieces are not supported")
                elif what == NORMAL:
                    ids[piece], score[piece] = i, struct.unpack("<f", part[2])[0] if 2 in part else 0.0
            elif number == 2:
                spec = dict(_fields(value))
                kind, byte_fallback, suffix = spec.get(3, 1), spec.get(35, 0), spec.get(24, 0)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, prefix, one_space = spec.get(2, b""), spec.get(3, 1), spec.get(4, 1)
        if kind not in (1, 2) or suffix:
            raise ValueError("only unigram and BPE models with marks before words are supported")
        fallback = [byte_ids.get(b, unk_id) for b in range(256)] if byte_fallback else []
        return cls(ids, score, fallback, text_of, unk_id, kind == 2, rewrite_rules(charsmap), bool(prefix), bool(one_space))

    # --- the neighbours of a BPE model ---

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best-scored neighbours first, of equal ones the leftmost."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        parts, last = list(text), ("", "")
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def _last_merge(self, piece: str) -> tuple[str, str]:
        """The two parts that merging puts together last to a piece; empty where it does not come to the piece."""
        parts, last = self._merge(piece)
        return last if parts == [piece] else ("", "")

    def _neighbours(self, a: str, b: str) -> bool:
        """Whether the arc from a to b has weight 0.

        Both pieces are taken apart from the one merged last on; between two such steps, the parts at their border must not
        merge earlier than the part that was taken apart.
        """
        if not a:
            return True
        if a in self.slow or b in self.slow:
            return self.merged(a + b) == [a, b]
        score, split = self.score, self.split
        limit, equal = -math.inf, True
        while True:
            s = score.get(a + b)
            if s is not None and (s > limit or (equal and s == limit)):
                return False
            left, right = split.get(a), split.get(b)
            if left and (not right or score[a] < score[b]):
                limit, equal, a = score[a], False, left[1]
            elif right:
                limit, equal, b = score[b], True, right[0]
            else:
                return True

    # --- composition with a word, and its shortest path ---

    def shortest(self, word: str) -> bytes:
        """Ids on the least path of one normalised word, as little-endian bytes."""
        return self._bpe_path(word) if self.bpe else self._unigram_path(word)

    def _leaving(self, word: str, s: int) -> list[str]:
        """The pieces on the arcs that leave position s, the longest last; a character that is no piece is one, too."""
        state, e, n = self.pieces, s, len(word)
        out: list[str] = []
        while e < n:
            state = state.get(word[e])
            if state is None:
                break
            e += 1
            if "" in state:
                out.append(state[""])
        return out if out and len(out[0]) == 1 else [word[s], *out]

    def _bpe_path(self, word: str) -> bytes:
        """Follows arcs of weight 0, the longest first; whether the end can be reached depends on the position alone, so dead ones are met once."""
        n, at, before = len(word), 0, ""
        if self.n_passes > self.most:
            self.passes, self.n_passes = {}, 0
        path: list[str] = []
        open_, dead = [self._leaving(word, 0)], set()
        while at < n:
            row = self.passes.get(before)
            if row is None:
                row = self.passes[before] = {}
            arcs = open_[-1]
            while arcs:
                piece = arcs.pop()
                e = at + len(piece)
                if e in dead:
                    continue
                fits = row.get(piece)
                if fits is None:
                    fits = row[piece] = self._neighbours(before, piece)
                    self.n_passes += 1
                if fits:
                    path.append(piece)
                    at, before = e, piece
                    if at < n:
                        open_.append(self._leaving(word, at))
                    break
            else:
                dead.add(at)
                open_.pop()
                at -= len(path.pop())
                before = path[-1] if path else ""
        return self._outputs(path)

    def _unigram_path(self, word: str) -> bytes:
        n = len(word)
        come: list[str | None] = [None] * (n + 1)
        cost = [0.0] + [math.inf] * n
        for s in range(n):
            state, e, known = self.pieces, s, False
            while e < n:
                state = state.get(word[e])
                if state is None:
                    break
                e += 1
                piece = state.get("")
                if piece is not None:
                    known = known or e == s + 1
                    if cost[s] - self.score[piece] < cost[e]:
                        cost[e], come[e] = cost[s] - self.score[piece], piece
            if not known and cost[s] + self.unknown < cost[s + 1]:
                cost[s + 1], come[s + 1] = cost[s] + self.unknown, word[s]
        path: list[str] = []
        while n:
            path.append(come[n])
            n -= len(path[-1])
        return self._outputs(path[::-1])

    def _outputs(self, path: list[str]) -> bytes:
        out: list[int] = []
        for piece in path:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not (out and out[-1] == self.unk_id):  # unknown characters in a row are one
                out.append(self.unk_id)
        return struct.pack(f"<{len(out)}i", *out)

    # --- whole texts ---

    def normalise(self, text: str) -> str:
        if self.rules:
            out, at = [], 0
            while at < len(text):
                state, e, best, end = self.rewrite, at, text[at], at + 1
                while e < len(text) and (state := state.get(text[e])) is not None:
                    e += 1
                    if "" in state:
                        best, end = state[""], e
                out.append(best)
                at = end
            text = "".join(out)
        if self.one_space:
            text = " ".join(filter(None, text.split(" ")))
        text = text.replace(" ", MARK)
        return MARK + text if text and self.dummy_prefix else text

    def _new(self, words: list[str]) -> list[bytes]:
        """Paths of words that the table lacks; the parts of a word that no piece leaves are composed apart."""
        out = []
        if len(self.paths) > self.most:
            self.paths.clear()
        paths = self.paths
        for word in words:
            found = []
            for part in self.words.findall(word) if self.apart else [word]:
                ids = paths.get(part)
                if ids is None:
                    ids = self.shortest(part)
                    if len(part) <= 64:
                        paths[part] = ids
                found.append(ids)
            out.append(found[0] if len(found) == 1 else b"".join(found))
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (nulls have none), one after another, and where each text's begin, with the end of the last."""
        texts = texts.fill_null("")
        if self.rules or self.one_space or not self.dummy_prefix:
            texts = pa.array([self.normalise(t) for t in texts.to_pylist()], pa.string())
        else:
            marked = pc.replace_substring(texts, " ", MARK)
            texts = pc.if_else(pc.equal(pc.binary_length(marked), 0), "", pc.binary_join_element_wise(MARK, marked, ""))
        if not self.apart or pc.any(pc.match_substring(texts, "\0")).as_py():
            parts = [self.words.findall(t) if self.apart else [t] for t in texts.to_pylist()]
            split = pa.array(parts, pa.list_(pa.string()))
        else:
            split = pc.split_pattern(pc.replace_substring_regex(texts, f"([^{MARK}]){MARK}", rf"\1{chr(0)}{MARK}"), "\0")
        return ragged(*self.table.look_up(split, self._new), "<i4")

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode_all(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """Bytes of each text; the mark that encoding put before the text goes."""
        data, at = ragged(self.outputs.take(pa.array(ids)), begin, "u1")
        cut = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return [x[1:] if self.dummy_prefix and x[:1] == b" " else x for x in cut]


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, n_ids, ids_crc32, decoded_same) of every whole text.

    decoded_same tells whether decoding gives the text back; it is false only for texts with U+2581 or broken
    characters in them, or that the model's normaliser changes. Null and empty texts have no ids; an empty table gives
    an empty result; repeated rows are kept; other columns are left out. Narrow: no shuffle; a worker's tables are bounded,
    and a word of any length is one path.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = Transducer.of(model)
        for batch in gathered(batches, 1, 1 << 22):
            ids, begin = fst.encode_all(batch.column(1))
            texts = batch.column(1).fill_null("").cast(pa.binary()).to_pylist()
            same = [x == t for x, t in zip(fst.decode_all(ids, begin), texts, strict=True)]
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(begin), pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], names=[key, "ids", "n_ids", "ids_crc32", "decoded_same"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, n_ids long, ids_crc32 long, decoded_same boolean")


def decode(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from ids; null ids give a null text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = Transducer.of(model)
        for batch in batches:
            lists = [np.array(x or (), np.int64) for x in batch.column(1).to_pylist()]
            begin = np.cumsum([0] + [len(x) for x in lists])
            texts = [x.decode("utf-8", "replace") for x in fst.decode_all(np.concatenate([np.zeros(0, np.int64), *lists]), begin)]
            texts = [t if v else None for t, v in zip(texts, batch.column(1).is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")

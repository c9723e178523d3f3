"""URL filtering with a bit-parallel wildcard automaton.

All rules are packed into the bits of a few 64-bit words. One Shift-And step per symbol advances every rule for a
whole batch of URLs: shift the state, keep the bits whose rule symbol equals the input symbol, and keep the bits
of `*` positions, which loop. `*` in a host never crosses into the path, as the host ends with a symbol of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOST_END = 256
ANY_BYTE = -1
STAR = -2


@dataclass(frozen=True)
class Rule:
    """verdict for URLs whose host is `host` or a subdomain and whose path starts with `path`; `*` and `?` are wildcards."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Automaton:
    """The packed rules: one start bit and one bit for each symbol of every rule."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        symbols, self.final, start = [], [], []
        for rule in self.rules:
            start.append(len(symbols))
            symbols.append(None)
            # a leading dot on rule and input anchors the host at a label's start
            symbols += [STAR, ord("."), *_glob(rule.host), HOST_END, *_glob(rule.path), STAR]
            self.final.append(len(symbols) - 1)
        # STAR is no symbol to consume: its loop belongs to the position before it
        bits, loops, place = [], [], {}
        for i, s in enumerate(symbols):
            if s == STAR:
                loops.append(len(bits) - 1)
            else:
                bits.append(s)
            place[i] = len(bits) - 1
        self.final = [place[i] for i in self.final]
        start = [place[i] for i in start]
        self.words = max(1, -(-len(bits) // 64))
        self.take = np.zeros((HOST_END + 1, self.words), np.uint64)
        self.loop = np.zeros((HOST_END + 1, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for i, s in enumerate(bits):
            hit = [] if s is None else range(HOST_END) if s == ANY_BYTE else [s]
            for c in hit:
                self.take[c, i >> 6] |= np.uint64(1 << (i & 63))
        for i in loops:
            self.loop[:HOST_END, i >> 6] |= np.uint64(1 << (i & 63))
        for i in start:
            self.start[i >> 6] |= np.uint64(1 << (i & 63))
        # the longest rule wins; of equally long ones the first
        self.order = sorted(range(len(self.rules)), key=lambda k: -len(self.rules[k].name))

    def run(self, texts: list[tuple[bytes, bytes]]) -> np.ndarray:
        """Index of the winning rule for each (host, path), -1 for none."""
        best = np.full(len(texts), -1, np.int64)
        if not texts:
            return best
        flat = [np.frombuffer(b"." + h, np.uint8).astype(np.int16).tolist() + [HOST_END] + list(p) for h, p in texts]
        size = np.array([len(x) for x in flat])
        by_size = np.argsort(-size, kind="stable")
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])[by_size]
        stream = np.concatenate([np.array(x, np.int16) for x in flat])
        alive = len(texts) - np.searchsorted(size[by_size][::-1], np.arange(1, size.max() + 1))
        state = np.repeat(self.start[None], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for t, k in enumerate(alive):
            now, symbol = state[:k], stream[begin[:k] + t]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:k] = (moved & self.take[symbol]) | (now & self.loop[symbol])
        for r in reversed(self.order):
            bit = self.final[r]
            hit = (state[:, bit >> 6] >> np.uint64(bit & 63)) & one
            best[by_size[hit == one]] = r
        return best


def _glob(text: str) -> list[int]:
    out: list[int] = []
    for c in text:
        out += [STAR] if c == "*" else [ANY_BYTE] if c == "?" else list(c.encode())
    return out


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path: what stands after the first `://` up to `/ ? #`, lower-cased in A-Z; then up to `? #`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(F.col(url), F.instr(url, "://") + F.lit(3)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumns({"host": F.translate(host, upper, lower), "path": path})


def filter_urls(df: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """Judge every URL: (key, host, path, rule, verdict).

    Rows keep their number and are never joined or shuffled. A null URL, or one without `://`, has an empty host
    and path, fits no rule that names either, and gets `default`. Repeated rows are judged each for itself; an
    empty table gives an empty result; other columns, also ones called host, path, rule or verdict, are left out.
    """
    kind = df.schema[key].dataType
    rules = list(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(rules)
        for batch in batches:
            host, path = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            won = auto.run([(h.encode(), p.encode()) for h, p in zip(host, path, strict=True)])
            names = [rules[r].name if r >= 0 else None for r in won]
            verdicts = [rules[r].verdict if r >= 0 else default for r in won]
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "host", "path", "rule", "verdict"])

    slim = split_url(df.select(key, F.col(url).alias("_url")), "_url").select(key, "host", "path")
    return slim.mapInArrow(judge, f"{key} {kind.simpleString()}, host string, path string, rule string, verdict string")

"""Terms of whole texts: runs of letters, of digits where asked for, and of everything beyond ASCII, A-Z in lower case."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def folding(digits: bool) -> bytes:
    """What each byte becomes: A-Z the small letter, other bytes of terms themselves, the rest a space."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in range(97, 123):
        out[c] = out[c - 32] = c
    if digits:
        out[48:58] = b"0123456789"
    return bytes(out)


WORDS, WORDS_AND_DIGITS = folding(False), folding(True)


def terms_of(texts: pa.Array, fold: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, the place among them of each term from first to last, the text it is in); null texts are empty.

    All ASCII that no term holds becomes a space at once, which leaves the texts' ends where they are.
    """
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    plain = (data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b"").translate(fold)
    texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(plain))
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    ends = split.offsets.to_numpy()
    codes, at = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(ends))
    blank = pc.index(coded.dictionary, "").as_py()  # before a first and after a last term
    if blank >= 0:
        some = codes != blank
        codes, at = codes[some], at[some]
    return coded.dictionary, codes.astype(np.int64), at

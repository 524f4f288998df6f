"""Words of a batch of texts, as numbers into the batch's distinct words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def folded(texts: pa.StringArray, table: bytes) -> pa.StringArray:
    """Every byte of UTF-8 replaced by the table, which leaves those above 0x7F alone; null: empty."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")])  # own buffers, offset 0
    _, offsets, data = texts.buffers()
    data = data.to_pybytes().translate(table) if data is not None else b""
    return type(texts).from_buffers(len(texts), offsets, pa.py_buffer(data))


def numbered(texts: pa.StringArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers, the distinct words, and the text of each word; words stand between blanks."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    numbers, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    some = np.ones(len(distinct) + 1, dtype=bool)
    blank = pc.index(distinct, "").as_py()
    some[blank] = blank < 0  # at -1 the spare place
    kept = some[numbers]
    return numbers[kept], distinct, owner[kept]

"""Functions that built-in ones can't express: UDFs over Arrow arrays.

They turn one text at a time into a Python string. As pandas series all texts of a batch would stand in memory at once, and
their results once more.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, StringType


def common_start(a: str, b: str) -> int:
    """How many characters two texts begin with alike, by halving: slices are compared in C."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel. Common ends belong to one of the longest, so only what is
    between them costs the product of both lengths."""
    head = common_start(a, b)
    a, b = a[head:], b[head:]
    tail = common_start(a[::-1], b[::-1])
    return head + tail + _lcs(a[: len(a) - tail], b[: len(b) - tail])


def _lcs(a: str, b: str) -> int:
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


@F.arrow_udf(DoubleType())
def indel_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """200 * LCS / (|a| + |b|); 100 for two empty texts; null if either is."""
    one = lambda x, y: None if x is None or y is None else 100.0 if not x and not y else 200.0 * lcs(x, y) / (len(x) + len(y))
    return pa.array([one(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.float64())


#: Comments, or strings and character literals, of a C-like language, from left to right; open ones reach the end.
_LEXER = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|"(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z)""", re.S)
#: Double-quoted strings alone, for languages whose single quotes and comments don't matter.
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)', re.S)


def lexer_mask(code: str, strings_only: bool = False) -> np.ndarray:
    """1 for characters of plain code: outside strings, character literals and comments; with strings_only, outside
    double-quoted strings."""
    out = np.ones(len(code), np.int8)
    for m in (_QUOTED if strings_only else _LEXER).finditer(code):
        out[m.start() : m.end()] = 0
    return out


def without_comments(code: str, strings: bool = False) -> str:
    """Code without comments; strings stay, unless they are to go too."""
    return _LEXER.sub(lambda m: "" if strings or m["comment"] else m[0], code)


def masks_of(codes: Iterable, strings_only: bool = False) -> pa.Array:
    """The masks of an array of texts, one behind the other in one buffer."""
    parts, ends = [np.zeros(0, np.int8)], [0]
    for x in codes:
        if x.is_valid:
            parts.append(lexer_mask(x.as_py(), strings_only))
            ends.append(ends[-1] + len(parts[-1]))
        else:
            ends.append(ends[-1])
    null = np.array([not x.is_valid for x in codes], bool)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)), mask=pa.array(null, pa.bool_()))


@F.arrow_udf(ArrayType(ByteType()))
def normal_mask(code: pa.Array) -> pa.Array:
    return masks_of(code)


@F.arrow_udf(ArrayType(ByteType()))
def string_mask(code: pa.Array) -> pa.Array:
    return masks_of(code, True)


@F.arrow_udf(StringType())
def _without_comments(code: pa.Array) -> pa.Array:
    return pa.array((without_comments(x.as_py()) if x.is_valid else None for x in code), pa.string())


@F.arrow_udf(StringType())
def _without_both(code: pa.Array) -> pa.Array:
    return pa.array((without_comments(x.as_py(), True) if x.is_valid else None for x in code), pa.string())


def strip_code(code: Column, strings: bool) -> Column:
    """Code without comments, and without strings if they are to go too."""
    return (_without_both if strings else _without_comments)(code)


def strip_comments(code: Column) -> Column:
    return strip_code(code, False)

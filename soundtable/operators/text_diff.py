"""Line diffs of pairs of texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines shown around a change; places up to which a line's bits are set one by one.
CONTEXT, FEW = 3, 8


def lines_of(text: str | None) -> list[str]:
    """Lines without LF or CR LF; an end of line at the very end begins no other."""
    parts = (text or "").split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def _bits(places: list[int], length: int) -> int:
    if len(places) <= FEW:
        return sum(1 << k for k in places)
    flags = np.zeros(length, np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _common(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; of equal ways the one that goes on in a first.

    A line of a has one whole number with a bit for each line of b, last line lowest: unset where the length grows that is
    common to what follows in a and from there in b. One number in sqrt(len(a)) is kept, the ones between are made again when the
    pairs get there. Lines of a that b lacks change nothing."""
    length, places = len(b), {}
    for k, x in enumerate(reversed(b)):
        places.setdefault(x, []).append(k)
    # Fewer than sqrt(len(b)) lines are so frequent that their bits are kept.
    found = {x: _bits(p, length) if len(p) > max(FEW, math.isqrt(length)) else p for x, p in places.items()}
    rows = [(i, found[x]) for i, x in enumerate(a) if x in found]
    size = math.isqrt(len(rows)) + 1

    def equal(p: int | list[int]) -> int:
        return p if isinstance(p, int) else _bits(p, length)

    def before(same: int, p: int | list[int], whole: int) -> int:
        hit = same & equal(p)
        return (same + hit | same - hit) & whole

    whole = same = (1 << length) - 1
    kept = []
    for r in range(len(rows), 0, -1):
        if r % size == 0 or r == len(rows):
            kept.append(same)
        same = before(same, rows[r - 1][1], whole)
    left = length
    for begin in range(0, len(rows), size):
        part, whole = rows[begin : begin + size], (1 << left) - 1
        block = [kept.pop() & whole]
        for _, p in reversed(part):
            block.append(before(block[-1], p, whole))
        for i, p in part:
            here, below = block.pop(), block[-1]
            # Set where going on in a loses a pair: growth that this line has and the next has not opens such a run of bits, the reverse ends it.
            loses = (here & ~below) - (below & ~here)
            left = ((equal(p) | ~loses) & ((1 << left) - 1)).bit_length()
            if left and a[i] == b[-left]:
                yield i, length - left
                left -= 1
            if not left:
                return


def opcodes(before: list[str], after: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(equal, replace, delete or insert; range in before; range in after) in order; equal beginnings and ends are set apart first."""
    n, m, head, tail = len(before), len(after), 0, 0
    while head < min(n, m) and before[head] == after[head]:
        head += 1
    while tail < min(n, m) - head and before[n - 1 - tail] == after[m - 1 - tail]:
        tail += 1
    matches = [(i + head, j + head) for i, j in _common(before[head : n - tail], after[head : m - tail])]
    # Runs of matched lines, the equal beginning and end among them, and what lies between them.
    runs = [(0, 0, head)] if head else []
    for i, j in matches:
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j and (i, j) != (head, head):
            runs[-1] = (*runs[-1][:2], runs[-1][2] + 1)
        else:
            runs.append((i, j, 1))
    runs.append((n - tail, m - tail, tail))
    out, i, j = [], 0, 0
    for at, to, size in runs:
        if i < at or j < to:
            out.append(("replace" if i < at and j < to else "delete" if i < at else "insert", i, at, j, to))
        if size:
            out.append(("equal", at, at + size, to, to + size))
        i, j = at + size, to + size
    return out


def hunks(codes: list[tuple[str, int, int, int, int]], context: int = CONTEXT) -> list[list[tuple[str, int, int, int, int]]]:
    """Opcodes in groups of changes with up to `context` equal lines around them, split where more than twice that lie between."""
    groups: list[list] = [[]]
    for k, (kind, i1, i2, j1, j2) in enumerate(codes):
        if kind != "equal":
            groups[-1].append((kind, i1, i2, j1, j2))
            continue
        first, last, length = k == 0, k == len(codes) - 1, i2 - i1
        if not first and not last and length <= 2 * context:
            groups[-1].append((kind, i1, i2, j1, j2))
            continue
        keep = min(context, length)
        if not first:
            groups[-1].append((kind, i1, i1 + keep, j1, j1 + keep))
        if not last:
            groups += [[]] if not first else []
            groups[-1].append((kind, i2 - keep, i2, j2 - keep, j2))
    return [[c for c in g if c[1] < c[2] or c[3] < c[4]] for g in groups if any(c[0] != "equal" for c in g)]


def _range(begin: int, end: int) -> str:
    return str(begin + 1) if end - begin == 1 else f"{begin + (end > begin)},{end - begin}"


def diff_chunks(pairs: DataFrame, key: str, before: str, after: str, context: int = CONTEXT) -> DataFrame:
    """(key, hunk, header, removed, added, text): the hunks of a unified diff of each pair of texts, in order.

    removed and added count the hunk's lines; text has its lines with their marks. Equal pairs have no row. Null is an
    empty text. A pair is one row and one task's work; its middle is aligned by a longest common subsequence whatever its
    size, in time of lines times lines and memory of lines times their root. A null key is a key like any other, pairs may repeat."""

    # Rows of texts go to Python a hundred at a time; an Arrow batch would hold ten thousand, whatever their length.
    @F.udf("array<struct<hunk: int, header: string, removed: int, added: int, text: string>>", useArrow=False)
    def diff(x, y):
        a, b = lines_of(x), lines_of(y)
        rows = []
        for number, group in enumerate(hunks(opcodes(a, b), context) if a != b else []):
            text = []
            for kind, i1, i2, j1, j2 in group:
                text += [" " + v for v in a[i1:i2]] if kind == "equal" else [*("-" + v for v in a[i1:i2]), *("+" + v for v in b[j1:j2])]
            header = f"@@ -{_range(group[0][1], group[-1][2])} +{_range(group[0][3], group[-1][4])} @@"
            gone, come = (sum(c[k + 1] - c[k] for c in group if c[0] != "equal") for k in (1, 3))
            rows.append((number, header, gone, come, "\n".join(text)))
        return rows

    return pairs.select(F.col(f"`{key}`"), F.inline(diff(F.col(f"`{before}`"), F.col(f"`{after}`"))))

"""Lines of a scanned page in the order a reader takes them."""

from __future__ import annotations

#: Left edges further apart than this many pixels belong to different columns.
COLUMN_GAP = 80


def reading_order(text: str, x0: list[int] | None, y0: list[int] | None) -> list[str]:
    """The lines of ``text``, column after column, each downwards.

    Columns are groups of lines of nearby left edges.  Where there isn't one
    box for each line, the order stays that of the text.
    """
    lines = text.split("\n")
    if x0 is None or y0 is None or len(x0) != len(lines) or len(y0) != len(lines) or any(v is None for v in x0) or any(v is None for v in y0):
        return lines
    column, last, at = {}, None, 0
    for x in sorted(set(x0)):
        if last is not None and x - last > COLUMN_GAP:
            at += 1
        column[x], last = at, x
    if not at and all(a <= b for a, b in zip(y0, y0[1:], strict=False)):
        return lines
    return [lines[i] for i in sorted(range(len(lines)), key=lambda i: (column[x0[i]], y0[i], i))]

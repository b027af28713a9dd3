"""A plain version of the table's rules, on Python lists."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Cell:
    row: str
    cf: str
    cf_id: int
    cq: str
    ts: int
    rev: int
    flag: int
    value: str | None = None

    def key(self):
        return (self.row.encode(), self.cf_id, self.cq.encode(), self.flag, -self.ts, -self.rev)


def inside_row(row: str, r) -> bool:
    b = row.encode()
    if r.prefix is not None:
        return b.startswith(r.prefix.encode())
    if r.start is not None and (b < r.start.encode() or b == r.start.encode() and not r.start_inclusive):
        return False
    return not (r.end is not None and (b > r.end.encode() or b == r.end.encode() and not r.end_inclusive))


def inside_cell(c: Cell, i, ids: dict[str, int]) -> bool:
    if i.prefix is not None:
        family, _, qualifier = i.prefix[1].partition(":")
        return c.row == i.prefix[0] and c.cf_id == ids[family] and c.cq.startswith(qualifier)

    def versus(bound):
        """-1, 0 or 1: the cell is before, at or after the bound; a bound without a qualifier is a whole family."""
        family, colon, qualifier = bound[1].partition(":")
        own, other = (c.row.encode(), c.cf_id), (bound[0].encode(), ids[family])
        if colon:
            own, other = (*own, c.cq.encode()), (*other, qualifier.encode())
        return (own > other) - (own < other)

    if i.start is not None and (versus(i.start) < 0 or versus(i.start) == 0 and not i.start_inclusive):
        return False
    return not (i.end is not None and (versus(i.end) > 0 or versus(i.end) == 0 and not i.end_inclusive))


def scan(cells, schema, spec, now=None):
    """``(ord, cell)`` in order."""
    families = {f.name: f for f in schema.live()}
    ids = {f.name: f.id for f in schema.live()}
    wanted = {ids[n]: families[n] for n in spec.families or families}
    found = [c for c in cells if (spec.as_of is None or c.rev <= spec.as_of) and (c.flag == 0 or c.cf_id in wanted)]
    found = [c for c in found if c.flag == 0 or not wanted[c.cf_id].ttl or c.ts >= now - wanted[c.cf_id].ttl * 10**9]
    keys = {0: lambda c: c.row, 1: lambda c: (c.row, c.cf_id), 2: lambda c: (c.row, c.cf_id, c.cq)}
    limits: dict = {}
    for c in found:
        if c.flag in keys:
            k = (c.flag, keys[c.flag](c))
            limits[k] = max(limits.get(k, c.ts), c.ts)
    hidden = lambda c: any(c.ts < limits.get((f, k(c)), c.ts) for f, k in keys.items())
    found = [c for c in found if (c.flag == 255 and not hidden(c)) or (c.flag != 255 and spec.return_deletes)]
    if spec.rows:
        placed = [(n, c) for n, r in enumerate(spec.rows) for c in found if inside_row(c.row, r)]
    elif spec.cells:
        placed = [(n, c) for n, i in enumerate(spec.cells) for c in found if c.flag == 255 and inside_cell(c, i, ids)]
    else:
        placed = [(0, c) for c in found]
    low, high = spec.time
    if not spec.return_deletes:
        placed = [(n, c) for n, c in placed if (low is None or c.ts >= low) and (high is None or c.ts < high)]
    placed.sort(key=lambda x: (x[0], x[1].key()))
    if not spec.return_deletes:
        seen: dict = {}
        kept = []
        for n, c in placed:
            k = (n, c.row, c.cf_id, c.cq)
            seen[k] = seen.get(k, 0) + 1
            most = [x for x in (spec.revs, wanted[c.cf_id].max_versions) if x]
            if not most or seen[k] <= min(most):
                kept.append((n, c))
        placed = kept
    if spec.limit:
        first = list(dict.fromkeys((n, c.row) for n, c in placed))[: spec.limit]
        placed = [(n, c) for n, c in placed if (n, c.row) in set(first)]
    return placed

"""An index of filters by their sorted literals.

A filter on a column excludes a row group whose upper bound lies below its lower literal, or whose lower bound lies above its upper one. So the
literals of all filters on a path are sorted once, for each way in which a column's kind reads them, and a row group's bound is
looked up by binary search: the filters that it fails are those before or behind that place. No filter is tested against a row group
that it keeps.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ways to read a literal, with the column's kind and the literal's: other than whole numbers are compared with int columns as doubles.
FIELDS = {"num": ("num", "num"), "int": ("int", "int"), "whole": ("int", "num"), "str": ("str", "str"), "ts": ("ts", "ts"), "bool": ("bool", "bool")}


def _number(bound) -> float:
    return float(bound["int"]) if bound["kind"] == "int" else bound["num"]


class Cuts:
    """Literals in order, and the filter sets that they belong to."""

    def __init__(self):
        self.pairs: list[tuple] = []

    def close(self) -> None:
        self.pairs.sort(key=lambda x: x[0])
        self.values = [v for v, _ in self.pairs]
        self.sets = np.array([s for _, s in self.pairs], np.int32)
        del self.pairs

    def above(self, bound) -> np.ndarray:
        """Sets whose literal is above the bound."""
        return self.sets[bisect_right(self.values, bound) :]

    def below(self, bound) -> np.ndarray:
        return self.sets[: bisect_left(self.values, bound)]


class FilterIndex:
    """rows: number of the set, column, side (lower, upper, is_null, is_not_null or none), both, and the literal in each way of FIELDS."""

    def __init__(self, rows, nan_bound: str = "prune"):
        self.nan_fails = nan_bound != "unknown"
        # by path, the column's kind, the literal's kind, and whether both bounds must be known
        self.lower: dict[tuple, Cuts] = {}
        self.upper: dict[tuple, Cuts] = {}
        self.nulls: dict[tuple[str, str], list[int]] = {}
        for number, path, side, both, *literals in rows:
            if side in ("is_null", "is_not_null"):
                self.nulls.setdefault((path, side), []).append(number)
            elif side is not None:
                cuts = self.lower if side == "lower" else self.upper
                for (kind, lit), v in zip(FIELDS.values(), literals, strict=True):
                    if v is not None:
                        cuts.setdefault((path, kind, lit, both), Cuts()).pairs.append((int(v) if lit == "int" else v, number))
        for cuts in (*self.lower.values(), *self.upper.values()):
            cuts.close()
        self.nulls = {k: np.array(v, np.int32) for k, v in self.nulls.items()}
        self.paths = {k[0] for k in (*self.lower, *self.upper, *self.nulls)}

    @classmethod
    def of(cls, t: pa.Table, nan_bound: str = "prune") -> tuple[pa.Array, FilterIndex]:
        """The names of a table's filter_set in order, and the index of its rows, where the sets bear the numbers of their names."""
        names = pc.unique(t.column("filter_set")).sort()
        number = pc.index_in(t.column("filter_set"), value_set=names)
        return names, cls(zip(number.to_pylist(), *[t.column(c).to_pylist() for c in ("column", "side", "both", *FIELDS)], strict=True), nan_bound)

    def _failing(self, cuts: dict, place, path: str, kind: str, bound, both_known: bool):
        for lit in ("num", "int") if kind in ("num", "int") else (kind,):
            for both in (True, False) if both_known else (False,):
                found = cuts.get((path, kind, lit, both))
                if found is None:
                    continue
                if lit in ("num", "int"):
                    if bound["kind"] not in ("num", "int"):
                        continue  # kinds that do not compare keep
                    if math.isnan(_number(bound)):
                        if self.nan_fails:
                            yield found.sets
                    elif lit == "int" and bound["kind"] == "int":
                        yield place(found, int(bound["int"]))
                    elif lit == "int":  # literals are compared as doubles: the order of their whole numbers is that of their doubles
                        yield self._as_doubles(found, place, bound["num"])
                    else:
                        yield place(found, _number(bound))
                elif bound["kind"] == lit:
                    yield place(found, bound[lit])

    @staticmethod
    def _as_doubles(cuts: Cuts, place, bound: float) -> np.ndarray:
        doubles = Cuts()
        doubles.values, doubles.sets = [float(v) for v in cuts.values], cuts.sets
        return place(doubles, bound)

    def failed(self, records: list) -> list[np.ndarray]:
        """Numbers of the filter sets that exclude a row group with these column records; of several of one path the first counts."""
        out, seen = [], set()
        for c in records:
            path = c["path"]
            if path not in self.paths or path in seen:
                continue
            seen.add(path)
            nulls, low, high = c["null_count"], c["min_raw"], c["max_raw"]
            if nulls is not None:
                if nulls <= 0:
                    out.append(self.nulls.get((path, "is_null"), ()))
                if c["num_values"] is not None and c["num_values"] <= nulls:
                    out.append(self.nulls.get((path, "is_not_null"), ()))
            kind = (low and low["kind"]) or (high and high["kind"])
            both = low is not None and high is not None
            if high is not None:
                out += self._failing(self.lower, Cuts.above, path, kind, high, both)
            if low is not None:
                out += self._failing(self.upper, Cuts.below, path, kind, low, both)
        return [x for x in out if len(x)]

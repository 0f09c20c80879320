"""SQL oracles in steps: each adds columns to the rows of the one before."""

from __future__ import annotations

from tidemark.plans.fixtures import BARS_1H

RUN = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
ORDER = "(PARTITION BY symbol ORDER BY ts)"


def last(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {ORDER}"


def full(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {last(n)} = {n} THEN {f}({x}) OVER {last(n)} END"


def sma(x: str, n: int) -> str:
    return full("avg", x, n)


def cross(a: str, b: str, up: bool = True) -> str:
    return f"coalesce({a} {'>' if up else '<'} {b} AND {lag(a)} {'<=' if up else '>='} {lag(b)}, false)"


class Steps:
    def __init__(self, prelude: str = BARS_1H, source: str = "bars"):
        self.ctes, self.at, self.n = [prelude], source, 0
        self.add(rn=f"row_number() OVER {ORDER}")

    def add(self, **columns: str) -> Steps:
        self.n += 1
        made = ", ".join(f"{x} AS {c}" for c, x in columns.items())
        self.ctes.append(f"s{self.n} AS MATERIALIZED (SELECT *, {made} FROM {self.at})")
        self.at = f"s{self.n}"
        return self

    def scan(self, name: str, x: str, alpha: float, seed: int = 1) -> Steps:
        """y = (1 - alpha) y + alpha x as one growing sum: right for series as short as the fixtures."""
        k = f"{name}_n"
        self.add(**{f"{name}_x": x})
        self.add(**{k: f"count({name}_x) OVER {RUN} - {seed}", f"{name}_m": f"avg({name}_x) OVER {RUN}"})
        self.add(**{f"{name}_u": f"CASE WHEN {name}_x IS NULL THEN NULL WHEN {k} = 0 THEN {name}_m WHEN {k} > 0 THEN {alpha!r} * {name}_x END"})
        return self.add(**{name: f"CASE WHEN {name}_u IS NOT NULL THEN pow({1 - alpha!r}, {k}) * sum({name}_u * pow({1 - alpha!r}, -{k})) OVER {RUN} END"})

    def ema(self, name: str, x: str, n: int, sma_seed: bool = False) -> Steps:
        return self.scan(name, x, 2 / (n + 1), n if sma_seed else 1)

    def wilder(self, name: str, x: str, n: int) -> Steps:
        return self.scan(name, x, 1 / n, n)

    def true_range(self) -> Steps:
        return self.add(tr=f"greatest(high - low, coalesce(abs(high - {lag('close')}), 0), coalesce(abs(low - {lag('close')}), 0))")

    def rsi(self, name: str, n: int) -> Steps:
        self.add(d=f"close - {lag('close')}").wilder("gain", "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", n).wilder("loss", "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END", n)
        return self.add(**{name: "CASE WHEN gain IS NOT NULL THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END"})

    def select(self, columns: str, where: str = "true") -> str:
        return f"WITH {', '.join(self.ctes)} SELECT {columns} FROM {self.at} WHERE {where}"

    def signal(self, raw: str, hold: int = 1, warmup: int = 0) -> str:
        self.add(raw=f"coalesce(({raw}), false)" + (f" AND rn > {warmup}" if warmup else ""))
        return self.select(f"symbol, ts, max(CASE WHEN raw THEN 1 ELSE 0 END) OVER {last(hold)} = 1 AS signal")

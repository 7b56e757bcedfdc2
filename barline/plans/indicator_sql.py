"""SQL of the indicators over the bars of the given tables, to hold the DataFrame forms against."""

from __future__ import annotations

import math

from .bars import SQL as BARS
from .bars import TAPE_SQL

_W = "PARTITION BY symbol ORDER BY date"


def f(aggregate: str, x: str, p: int) -> str:
    """An aggregate of the last p values of x, none of them null."""
    over = f"OVER ({_W} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {p} THEN {aggregate}({x}) {over} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({_W})"


def cum(x: str) -> str:
    return f"sum({x}) OVER ({_W} ROWS UNBOUNDED PRECEDING)"


def ema(source: str, x: str, p: int, first: int, mean: bool = True) -> str:
    """Of a relation (symbol, rn, x): symbol, rn, v, row by row."""
    seed = f"(SELECT avg({x}) FROM {source} s WHERE s.symbol = b.symbol AND s.rn BETWEEN {first - p + 1} AND {first})" if mean else f"b.{x}"
    return (
        f"SELECT b.symbol, b.rn, CAST({seed} AS DOUBLE) AS v FROM {source} b WHERE rn = {first} UNION ALL "
        f"SELECT b.symbol, b.rn, e.v + (b.{x} - e.v) * {2 / (p + 1)!r} FROM @ e JOIN {source} b ON b.symbol = e.symbol AND b.rn = e.rn + 1"
    )


def decayed(source: str, x: str, p: int, first: int, mean: bool = True) -> str:
    """As ``ema``, without recursion: the weighted sum of as many values before a row as count for 14 digits."""
    decay = (p - 1) / (p + 1)
    seed = f"avg({x}) OVER ({_W.replace('date', 'rn')} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)" if mean else x
    values = f"SELECT symbol, rn, CASE WHEN rn = {first} THEN {seed} ELSE {x} * {1 - decay!r} END AS u FROM {source}"
    return (
        f"WITH u AS MATERIALIZED (SELECT * FROM ({values}) WHERE rn >= {first}) SELECT a.symbol, a.rn, sum(u.u * pow({decay!r}, a.k)) AS v "
        f"FROM (SELECT symbol, rn, unnest(range({math.ceil(14 / -math.log10(decay))})) AS k FROM u) a JOIN u ON u.symbol = a.symbol AND u.rn = a.rn - a.k GROUP BY 1, 2"
    )


def sql(*steps: tuple[str, str], columns: tuple[str, ...]) -> str:
    """Bars, then each step (name, query); a query with @ is recursive. The last step has the columns."""
    parts = [BARS]
    for name, query in steps:
        parts.append(f"{name} AS ({query.replace('@', name)})" if "@" in query else f"{name} AS MATERIALIZED ({query})")
    shown = ", ".join(f"floor({c} * 10000 + 0.5) / 10000.0 AS {c}" if c != "obv" else c for c in columns)
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT symbol, date, {shown} FROM {steps[-1][0]}"


def _on(*names: str) -> str:
    return " ".join(f"LEFT JOIN {n} ON {n}.symbol = b.symbol AND {n}.rn = b.rn" for n in names)


_TP = "((high + low + close) / 3)"
_TR = f"SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars"
_MFV = "CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) * volume END"


def _change(k: int, zero: str = "NULL") -> str:
    return f"CASE WHEN {lag('close', k)} = 0 THEN {zero} ELSE (close - {lag('close', k)}) / {lag('close', k)} * 100 END"


def _index(out: str, sign: str) -> str:
    """Products as recursion, one row after another."""
    factor = f"CASE WHEN volume {sign} {lag('volume')} AND {lag('close')} <> 0 THEN 1 + (close - {lag('close')}) / {lag('close')} ELSE 1.0 END"
    walk = "SELECT symbol, rn, date, CAST(1000 AS DOUBLE) AS v FROM fs WHERE rn = 0 UNION ALL SELECT b.symbol, b.rn, b.date, e.v * b.f FROM @ e JOIN fs b ON b.symbol = e.symbol AND b.rn = e.rn + 1"
    return sql(("fs", f"SELECT *, {factor} AS f FROM bars"), ("w", walk), ("r", f"SELECT symbol, date, ln(v) AS {out}_ln FROM w"), columns=(f"{out}_ln",))


def _psar_free(ema=ema) -> dict[str, str]:
    one = lambda expression, column: sql(("r", f"SELECT *, {expression} AS {column} FROM bars"), columns=(column,))
    hh, ll = f("max", "high", 14), f("min", "low", 14)
    mid = lambda p: f"(({f('max', 'high', p)}) + ({f('min', 'low', p)})) / 2"
    uo = ", ".join(f"CASE WHEN ({f('sum', 'tr', p)}) = 0 THEN 0 ELSE ({f('sum', 'bp', p)}) / ({f('sum', 'tr', p)}) END AS r{p}" for p in (7, 14, 28))
    weights = " + ".join(f"lag(r, {k}) OVER ({_W}) * {10 - k}" for k in range(10))
    kst = " + ".join(f"{k} * ({f('avg', f'r{n}', p)})" for k, (n, p) in enumerate(((10, 10), (15, 10), (20, 10), (30, 15)), 1))
    extreme = lambda s, how: f"CASE WHEN count(*) OVER ({_W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) = 25 THEN ({how}({s}) OVER ({_W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)) END"
    aroon = [("a", f"SELECT *, {extreme('row(high, -rn)', 'max')} AS h, {extreme('row(low, rn)', 'min')} AS l FROM bars"), ("r", "SELECT *, (25 - (rn + struct_extract_at(h, 2))) / 25.0 * 100 AS aroon_up, (25 - (rn - struct_extract_at(l, 2))) / 25.0 * 100 AS aroon_down FROM a")]
    trend = "coalesce(last_value(CASE WHEN c > 0 THEN 1 WHEN c < 0 THEN -1 END IGNORE NULLS) OVER (" + _W + " ROWS UNBOUNDED PRECEDING), 1)"
    return {
        "i01_sma": one(f("avg", "close", 20), "sma"),
        "i02_ema": sql(("e", ema("bars", "close", 20, 19)), ("r", f"SELECT b.*, e.v AS ema FROM bars b {_on('e')}"), columns=("ema",)),
        "i03_macd": sql(("e", ema("bars", "close", 12, 11)), ("g", ema("bars", "close", 26, 25)), ("m", f"SELECT b.*, e.v - g.v AS macd FROM bars b {_on('e', 'g')}"), ("s", ema("m", "macd", 9, 33)), ("r", f"SELECT b.*, s.v AS signal, b.macd - s.v AS histogram FROM m b {_on('s')}"), columns=("macd", "signal", "histogram")),
        "i04_rsi": sql(("d", f"SELECT *, close - {lag('close')} AS d FROM bars"), ("g", "SELECT *, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS u, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END AS v FROM d"), ("s", f"SELECT *, {f('sum', 'u', 14)} AS gain, {f('sum', 'v', 14)} AS loss FROM g"), ("r", "SELECT *, CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi FROM s"), columns=("rsi",)),
        "i05_bollinger": sql(("m", f"SELECT *, {f('avg', 'close', 20)} AS middle, {f('stddev_pop', 'close', 20)} AS sd FROM bars"), ("r", "SELECT *, middle + 2 * sd AS upper, middle - 2 * sd AS lower FROM m"), columns=("middle", "upper", "lower")),
        "i06_atr": sql(("t", _TR), ("r", f"SELECT *, {f('avg', 'tr', 14)} AS atr FROM t"), columns=("atr",)),
        "i07_adx": sql(("t", _TR), ("u", f"SELECT *, high - {lag('high')} AS up, {lag('low')} - low AS down FROM t"), ("p", "SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS pd, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS md FROM u"), ("s", f"SELECT *, {f('avg', 'tr', 14)} AS atr, {f('sum', 'pd', 14)} AS ps, {f('sum', 'md', 14)} AS ms FROM p"), ("r", "SELECT *, CASE WHEN atr <> 0 AND ps / atr + ms / atr <> 0 THEN abs(ps / atr - ms / atr) / (ps / atr + ms / atr) * 100 END AS adx FROM s"), columns=("adx",)),
        "i08_supertrend": sql(("t", _TR), ("a", f"SELECT *, (high + low) / 2 + 3 * ({f('avg', 'tr', 10)}) AS up, (high + low) / 2 - 3 * ({f('avg', 'tr', 10)}) AS lo FROM t"), ("w", "SELECT symbol, rn, date, lo AS v FROM a WHERE rn = 9 UNION ALL SELECT b.symbol, b.rn, b.date, CASE WHEN b.close > e.v THEN b.lo ELSE b.up END FROM @ e JOIN a b ON b.symbol = e.symbol AND b.rn = e.rn + 1"), ("r", f"SELECT b.*, w.v AS supertrend FROM bars b {_on('w')}"), columns=("supertrend",)),
        "i09_stochastic": sql(("h", f"SELECT *, {hh} AS hh, {ll} AS ll FROM bars"), ("k", "SELECT *, CASE WHEN hh = ll THEN 0 ELSE (close - ll) / (hh - ll) * 100 END AS k FROM h"), ("r", f"SELECT *, {f('avg', 'k', 3)} AS d FROM k"), columns=("k", "d")),
        "i11_vwap": one(f"CASE WHEN {cum('volume')} <> 0 THEN {cum(f'{_TP} * volume')} / {cum('volume')} END", "vwap"),
        "i12_obv": sql(("s", f"SELECT *, coalesce(sign(close - {lag('close')}) * volume, 0) AS s FROM bars"), ("r", f"SELECT *, CAST({cum('s')} AS BIGINT) AS obv FROM s"), columns=("obv",)),
        "i13_mfi": sql(("t", f"SELECT *, {_TP} AS tp FROM bars"), ("g", f"SELECT *, CASE WHEN tp > {lag('tp')} THEN tp * volume ELSE 0.0 END AS u, CASE WHEN tp < {lag('tp')} THEN tp * volume ELSE 0.0 END AS v FROM t"), ("s", f"SELECT *, {f('sum', 'u', 14)} AS us, {f('sum', 'v', 14)} AS vs FROM g"), ("r", "SELECT *, CASE WHEN vs = 0 THEN 100 ELSE 100 - 100 / (1 + us / vs) END AS mfi FROM s"), columns=("mfi",)),
        "i14_cmf": sql(("m", f"SELECT *, {_MFV} AS mfv FROM bars"), ("r", f"SELECT *, CASE WHEN ({f('sum', 'volume', 20)}) <> 0 THEN ({f('sum', 'mfv', 20)}) / ({f('sum', 'volume', 20)}) END AS cmf FROM m"), columns=("cmf",)),
        "i15_ichimoku": sql(("m", f"SELECT *, {mid(9)} AS tenkan, {mid(26)} AS kijun, {mid(52)} AS span_b FROM bars"), ("r", "SELECT *, (tenkan + kijun) / 2 AS span_a FROM m"), columns=("tenkan", "kijun", "span_a", "span_b")),
        "i16_donchian": sql(("m", f"SELECT *, {f('max', 'high', 20)} AS upper, {f('min', 'low', 20)} AS lower FROM bars"), ("r", "SELECT *, (upper + lower) / 2 AS middle FROM m"), columns=("upper", "middle", "lower")),
        "i17_keltner": sql(("t", _TR), ("a", f"SELECT *, {f('avg', 'tr', 20)} AS atr FROM t"), ("e", ema("bars", "close", 20, 19)), ("r", f"SELECT b.*, e.v AS middle, e.v + 2 * atr AS upper, e.v - 2 * atr AS lower FROM a b {_on('e')}"), columns=("middle", "upper", "lower")),
        "i18_cci": sql(("t", f"SELECT *, {_TP} AS tp FROM bars"), ("m", f"SELECT *, {f('avg', 'tp', 20)} AS m, {f('list', 'tp', 20)} AS l FROM t"), ("d", "SELECT *, list_sum([abs(x - m) for x in l]) / 20 AS dev FROM m"), ("r", "SELECT *, CASE WHEN dev = 0 THEN 0 ELSE (tp - m) / (0.015 * dev) END AS cci FROM d"), columns=("cci",)),
        "i19_williams_r": sql(("h", f"SELECT *, {hh} AS hh, {ll} AS ll FROM bars"), ("r", "SELECT *, CASE WHEN hh = ll THEN 0 ELSE (hh - close) / (hh - ll) * -100 END AS williams_r FROM h"), columns=("williams_r",)),
        "i20_roc": one(_change(12, "0"), "roc"),
        "i21_ultimate_oscillator": sql(("p", f"SELECT *, coalesce({lag('close')}, close) AS pc FROM bars"), ("q", "SELECT *, close - least(low, pc) AS bp, greatest(high, pc) - least(low, pc) AS tr FROM p"), ("s", f"SELECT *, {uo} FROM q"), ("r", "SELECT *, CASE WHEN rn >= 28 THEN 100 * (4 * r7 + 2 * r14 + r28) / 7 END AS ultimate_oscillator FROM s"), columns=("ultimate_oscillator",)),
        "i22_trix": sql(("e", ema("bars", "close", 15, 0, False)), ("g", ema("e", "v", 15, 0, False)), ("h", ema("g", "v", 15, 0, False)), ("j", f"SELECT b.*, h.v FROM bars b {_on('h')}"), ("r", f"SELECT *, CASE WHEN {lag('v')} = 0 THEN 0 ELSE (v - {lag('v')}) / {lag('v')} * 100 END AS trix FROM j"), columns=("trix",)),
        "i23_aroon": sql(*aroon, columns=("aroon_up", "aroon_down")),
        "i24_aroon_oscillator": sql(*aroon, ("o", "SELECT *, aroon_up - aroon_down AS aroon_oscillator FROM r"), columns=("aroon_oscillator",)),
        "i25_dpo": one(f"CASE WHEN rn >= 30 THEN {lag('close', 11)} - ({f('avg', 'close', 20)}) END", "dpo"),
        "i26_vortex": sql(("t", f"SELECT *, CASE WHEN rn > 0 THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS tr, abs(high - {lag('low')}) AS vp, abs(low - {lag('high')}) AS vm FROM bars"), ("s", f"SELECT *, {f('sum', 'tr', 14)} AS trs, {f('sum', 'vp', 14)} AS vps, {f('sum', 'vm', 14)} AS vms FROM t"), ("r", "SELECT *, CASE WHEN trs <> 0 THEN vps / trs END AS vortex_plus, CASE WHEN trs <> 0 THEN vms / trs END AS vortex_minus FROM s"), columns=("vortex_plus", "vortex_minus")),
        "i27_emv": sql(("m", "SELECT *, (high + low) / 2 AS m FROM bars"), ("e", f"SELECT *, CASE WHEN high <> low AND volume <> 0 THEN (m - {lag('m')}) / (volume / (high - low)) END AS e FROM m"), ("r", f"SELECT *, {f('avg', 'e', 14)} AS emv FROM e"), columns=("emv",)),
        "i28_accumulation_distribution": sql(("m", f"SELECT *, {_MFV} AS mfv FROM bars"), ("r", f"SELECT *, {cum('mfv')} AS accumulation_distribution FROM m"), columns=("accumulation_distribution",)),
        "i29_force_index": one(f"(close - {lag('close')}) * volume", "force_index"),
        "i30_nvi": _index("nvi", "<"),
        "i31_pvi": _index("pvi", ">"),
        "i32_kvo": sql(("s", "SELECT *, high + low + close AS s FROM bars"), ("c", f"SELECT *, s - {lag('s')} AS c FROM s"), ("v", f"SELECT *, CASE WHEN high <> low AND c IS NOT NULL THEN volume * {trend} * abs(2 * abs(c) / (high - low) - 1) ELSE 0.0 END AS vf FROM c"), ("e", ema("v", "vf", 34, 0, False)), ("g", ema("v", "vf", 55, 0, False)), ("k", f"SELECT b.*, e.v - g.v AS k FROM bars b {_on('e', 'g')}"), ("h", ema("k", "k", 13, 0, False)), ("r", f"SELECT b.*, CASE WHEN b.rn >= 54 THEN b.k END AS kvo, CASE WHEN b.rn >= 54 THEN h.v END AS kvo_signal FROM k b {_on('h')}"), columns=("kvo", "kvo_signal")),
        "i33_chaikin_oscillator": sql(("m", f"SELECT *, {_MFV} AS mfv FROM bars"), ("ad", f"SELECT *, {cum('mfv')} AS ad FROM m"), ("e", ema("ad", "ad", 3, 2)), ("g", ema("ad", "ad", 10, 9)), ("r", f"SELECT b.*, e.v - g.v AS chaikin_oscillator FROM bars b {_on('e', 'g')}"), columns=("chaikin_oscillator",)),
        "i34_elder_ray": sql(("e", ema("bars", "close", 13, 12)), ("r", f"SELECT b.*, high - e.v AS bull_power, low - e.v AS bear_power FROM bars b {_on('e')}"), columns=("bull_power", "bear_power")),
        "i35_rvi": sql(("c", "SELECT *, close - open AS co, high - low AS hl FROM bars"), ("r", f"SELECT *, CASE WHEN ({f('sum', 'hl', 10)}) <> 0 THEN ({f('sum', 'co', 10)}) / ({f('sum', 'hl', 10)}) END AS rvi FROM c"), columns=("rvi",)),
        "i36_coppock": sql(("c", f"SELECT *, {_change(14)} + {_change(11)} AS r FROM bars"), ("o", f"SELECT *, ({weights}) / 55 AS coppock FROM c"), columns=("coppock",)),
        "i37_kst": sql(("c", "SELECT *, " + ", ".join(f"{_change(n)} AS r{n}" for n in (10, 15, 20, 30)) + " FROM bars"), ("o", f"SELECT *, {kst} AS kst FROM c"), columns=("kst",)),
    }


#: A state machine over the bars of a symbol: direction, gain, stop and extreme.
PARABOLIC = f"""WITH RECURSIVE {BARS},
  l AS MATERIALIZED (SELECT *, least(lag(low) OVER w, lag(low, 2) OVER w) AS low_before, greatest(lag(high) OVER w, lag(high, 2) OVER w) AS high_before FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  p AS (
    SELECT symbol, rn, date, TRUE AS up, CAST(0.02 AS DOUBLE) AS gain, low AS stop, high AS extreme FROM l WHERE rn = 0
    UNION ALL
    SELECT symbol, rn, date, up <> turned, CASE WHEN turned THEN CAST(0.02 AS DOUBLE) WHEN further THEN least(gain + CAST(0.02 AS DOUBLE), CAST(0.2 AS DOUBLE)) ELSE gain END, CASE WHEN turned THEN extreme ELSE stop END,
      CASE WHEN turned AND up THEN low WHEN turned THEN high WHEN further AND up THEN high WHEN further THEN low ELSE extreme END
    FROM (SELECT *, CASE WHEN up THEN low < stop ELSE high > stop END AS turned, CASE WHEN up THEN high > extreme ELSE low < extreme END AS further
      FROM (SELECT l.symbol, l.rn, l.date, l.low, l.high, p.up, p.gain, p.extreme,
          CASE WHEN p.up THEN least(p.stop + p.gain * (p.extreme - p.stop), l.low_before) ELSE greatest(p.stop + p.gain * (p.extreme - p.stop), l.high_before) END AS stop
        FROM p JOIN l ON l.symbol = p.symbol AND l.rn = p.rn + 1)))
  SELECT symbol, date, CASE WHEN rn > 0 THEN floor(stop * 10000 + 0.5) / 10000.0 END AS psar FROM p"""


#: Indicators over the tape: scans of every kind, and bounded frames of every kind.
LONG = (
    "i01_sma", "i02_ema", "i03_macd", "i05_bollinger", "i11_vwap", "i12_obv", "i17_keltner", "i18_cci", "i22_trix",
    "i23_aroon", "i28_accumulation_distribution", "i30_nvi", "i31_pvi", "i32_kvo", "i33_chaikin_oscillator", "i34_elder_ray",
)


def _product(out: str, sign: str) -> str:
    factor = f"CASE WHEN volume {sign} {lag('volume')} AND {lag('close')} <> 0 THEN close / {lag('close')} ELSE 1.0 END"
    total = f"ln(1000) + sum(ln(f)) OVER ({_W} ROWS UNBOUNDED PRECEDING)"
    return sql(("fs", f"SELECT *, {factor} AS f FROM bars"), ("r", f"SELECT symbol, date, {total} AS {out}_ln FROM fs"), columns=(f"{out}_ln",))


def long_sql() -> dict[str, str]:
    """The same over the tape, where a row cannot wait for the row before it."""
    found = _psar_free(decayed) | {"i30_nvi": _product("nvi", "<"), "i31_pvi": _product("pvi", ">")}
    return {f"long_{name}": found[name].replace(BARS, TAPE_SQL) for name in LONG}


def oracle_sql() -> dict[str, str]:
    return _psar_free() | {"i10_parabolic_sar": PARABOLIC}

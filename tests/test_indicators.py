from __future__ import annotations

import datetime
import random

import pytest

from barline.operators import indicators as I
from barline.operators.parabolic import stops

DAY = datetime.datetime(2024, 1, 1)


def bars(spark, close=None, high=None, low=None, open_=None, volume=None, symbol="A"):
    n = len(next(x for x in (close, high, low) if x is not None))
    column = lambda x, default: [float(v) for v in (x if x is not None else default)]
    close = column(close, high or [1] * n)
    high, low, open_ = column(high, close), column(low, close), column(open_, close)
    rows = [(symbol, DAY + datetime.timedelta(days=i), open_[i], high[i], low[i], close[i], int((volume or [100] * n)[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, date timestamp, open double, high double, low double, close double, volume long")


def values(df, *columns):
    rows = df.orderBy("date").collect()
    out = [[r[c] for r in rows] for c in columns]
    return out[0] if len(out) == 1 else out


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None), (got, want)
        assert g is None or g == pytest.approx(w, rel=1e-4, abs=1e-9), (got, want)


N = None
CASES = [
    (I.sma, dict(close=[10, 20, 30, 40, 50]), (3,), {"sma": [N, N, 20, 30, 40]}),
    (I.sma, dict(close=[10, 20, 30, 40]), (1,), {"sma": [10, 20, 30, 40]}),
    (I.ema, dict(close=[10, 20, 30, 40, 50]), (3,), {"ema": [N, N, 20, 30, 40]}),
    (I.ema, dict(close=[10, 20, 30, 40]), (1,), {"ema": [10, 20, 30, 40]}),
    (I.rsi, dict(close=[100, 102, 104, 103, 105]), (3,), {"rsi": [N, N, N, 80, 80]}),
    (I.rsi, dict(close=[100, 110, 105, 115]), (2,), {"rsi": [N, N, 66.6667, 66.6667]}),
    (I.rsi, dict(close=[100, 90, 80, 70]), (2,), {"rsi": [N, N, 0, 0]}),
    (I.bollinger, dict(close=[50, 50, 50]), (3,), {"middle": [N, N, 50], "upper": [N, N, 50], "lower": [N, N, 50]}),
    (I.atr, dict(high=[10, 12, 13, 15], low=[8, 9, 10, 12], close=[9, 11, 12, 14]), (3,), {"atr": [N, N, 8 / 3, 3]}),
    (I.atr, dict(high=[10, 12, 13], low=[8, 9, 10], close=[9, 20, 12]), (2,), {"atr": [N, 2.5, 6.5]}),
    (I.adx, dict(high=[10, 12, 13, 15], low=[8, 9, 10, 12], close=[9, 11, 12, 14]), (2,), {"adx": [N, 100, 100, 100]}),
    (I.adx, dict(high=[10] * 4, low=[8] * 4, close=[9] * 4), (2,), {"adx": [N] * 4}),
    (I.stochastic, dict(high=[10, 20, 30, 40, 50], low=[0] * 5, close=[5, 15, 25, 35, 45]), (2, 3), {"k": [N, 75, 83.3333, 87.5, 90], "d": [N, N, N, 81.94444, 86.94444]}),
    (I.stochastic, dict(close=[10, 10, 10]), (3, 2), {"k": [N, N, 0], "d": [N, N, N]}),
    (I.vwap, dict(high=[11, 13, 15], low=[9, 11, 13], close=[10, 12, 14], volume=[100, 200, 300]), (), {"vwap": [10, 11.33333, 12.66667]}),
    (I.vwap, dict(close=[10, 12, 14], volume=[0, 0, 100]), (), {"vwap": [N, N, 14]}),
    (I.obv, dict(close=[100, 105, 105, 95, 100], volume=[1000, 2000, 3000, 4000, 5000]), (), {"obv": [0, 2000, 2000, -2000, 3000]}),
    (I.mfi, dict(high=[11, 13, 15, 14], low=[9, 11, 13, 12], close=[10, 12, 14, 13]), (3,), {"mfi": [N, N, 100, 66.6667]}),
    (I.cmf, dict(high=[10, 12, 14], low=[8, 10, 12], close=[9, 12, 13], volume=[100, 200, 300]), (2,), {"cmf": [N, 0.66667, 0.4]}),
    (I.donchian, dict(high=[10, 15, 12, 20], low=[5, 8, 6, 10]), (3,), {"upper": [N, N, 15, 20], "middle": [N, N, 10, 13], "lower": [N, N, 5, 6]}),
    (I.keltner, dict(high=[10, 12, 13, 15], low=[8, 9, 10, 12], close=[9, 11, 12, 14]), (3, 2), {"middle": [N, N, 10.66667, 12.33333], "upper": [N, N, 16, 18.33333]}),
    (I.cci, dict(high=[11, 13, 15], low=[9, 11, 13], close=[10, 12, 14]), (3,), {"cci": [N, N, 100]}),
    (I.cci, dict(close=[10, 10, 10]), (3,), {"cci": [N, N, 0]}),
    (I.williams_r, dict(high=[10, 12, 14, 16], low=[0, 2, 4, 6], close=[5, 10, 12, 14]), (3,), {"williams_r": [N, N, -14.2857, -14.2857]}),
    (I.roc, dict(close=[100, 110, 120, 90]), (2,), {"roc": [N, N, 20, -18.1818]}),
    (I.roc, dict(close=[0, 100, 50]), (1,), {"roc": [N, 0, -50]}),
    (I.ultimate_oscillator, dict(high=[10] * 5, low=[8] * 5, close=[9] * 5), (2, 3, 4), {"ultimate_oscillator": [N, N, N, N, 50]}),
    (I.ultimate_oscillator, dict(close=[10] * 5), (2, 3, 4), {"ultimate_oscillator": [N, N, N, N, 0]}),
    (I.aroon, dict(high=[10, 12, 11, 13], low=[8, 9, 7, 10]), (3,), {"aroon_up": [N, N, 66.6667, 100], "aroon_down": [N, N, 100, 66.6667]}),
    (I.aroon_oscillator, dict(high=[10, 12, 11, 13], low=[8, 9, 7, 10]), (3,), {"aroon_oscillator": [N, N, -33.3333, 33.3333]}),
    (I.dpo, dict(close=[10, 12, 14, 16, 18, 20, 30, 32]), (4,), {"dpo": [N] * 6 + [-5, -7]}),
    (I.vortex, dict(high=[10, 12, 14], low=[8, 9, 10], close=[9, 11, 13]), (2,), {"vortex_plus": [N, N, 9 / 7], "vortex_minus": [N, N, 3 / 7]}),
    (I.emv, dict(high=[10, 12, 14, 16], low=[8, 10, 12, 14]), (2,), {"emv": [N, N, 0.04, 0.04]}),
    (I.emv, dict(high=[10, 12, 14], low=[8, 10, 12], volume=[100, 0, 100]), (1,), {"emv": [N, N, 0.04]}),
    (I.accumulation_distribution, dict(high=[10, 12], low=[8, 8], close=[10, 9], volume=[100, 200]), (), {"accumulation_distribution": [100, 0]}),
    (I.force_index, dict(close=[100, 105, 103, 110], volume=[1000, 2000, 3000, 4000]), (), {"force_index": [N, 10000, -6000, 28000]}),
    (I.nvi, dict(close=[100, 105, 110, 108], volume=[1000, 900, 1000, 800]), (1000,), {"nvi": [1000, 1050, 1050, 1050 * 108 / 110]}),
    (I.nvi, dict(close=[0, 100, 110], volume=[1000, 900, 800]), (1000,), {"nvi": [1000, 1000, 1100]}),
    (I.pvi, dict(close=[100, 110, 121, 120], volume=[100, 200, 300, 200]), (1000,), {"pvi": [1000, 1100, 1210, 1210]}),
    (I.chaikin_oscillator, dict(high=[10, 12, 14, 16], low=[8, 10, 12, 14], close=[10, 12, 14, 16]), (2, 3), {"chaikin_oscillator": [N, N, 50, 50]}),
    (I.elder_ray, dict(high=[11, 13, 15, 18], low=[9, 10, 11, 12], close=[10, 12, 14, 16]), (3,), {"bull_power": [N, N, 3, 4], "bear_power": [N, N, -1, -2]}),
    (I.rvi, dict(open_=[10, 11, 12, 13], high=[12, 13, 14, 15], low=[8, 9, 10, 11], close=[11, 12, 13, 14]), (2,), {"rvi": [N, 0.25, 0.25, 0.25]}),
    (I.coppock, dict(close=[0, 100, 110, 120]), (1, 1, 2), {"coppock": [N, N, N, 18.7878788]}),
    (I.kst, dict(close=[100, 110, 120, 130, 140]), ((1, 1, 1, 1), (1, 1, 1, 1)), {"kst": [N, 100, 90.90909, 83.33333, 76.92308]}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_small_series(spark, case):
    function, data, parameters, want = CASES[case]
    df = function(bars(spark, **data), *parameters)
    for column, expected in want.items():
        same(values(df, column), expected)


def test_macd_signal_begins_with_the_mean_of_valid_values(spark):
    macd, signal, histogram = values(I.macd(bars(spark, close=list(range(10, 20))), 3, 5, 2), "macd", "signal", "histogram")
    assert macd[:4] == [None] * 4 and macd[4] == pytest.approx(1)
    assert signal[4] is None and signal[5] == pytest.approx(1) and histogram[5] == pytest.approx(0, abs=1e-12)


def test_exponential_scan_equals_the_loop_over_long_series(spark):
    rng = random.Random(5)
    x = [rng.uniform(1, 100) for _ in range(3000)]
    for p in (2, 20):
        got = values(I.ema(bars(spark, close=x), p), "ema")
        e = sum(x[:p]) / p
        for i in range(p, len(x)):
            e += (x[i] - e) * 2 / (p + 1)
            assert got[i] == pytest.approx(e, rel=1e-10)


def test_parabolic_stop():
    got = stops([10, 11, 12, 13, 12, 11], [8, 9, 10, 11, 8, 7], 0.02, 0.2)
    assert got[0] is None and got[3] == pytest.approx(8.24) and got[4] == 13 and got[5] >= 11
    rising = stops([10, 11, 12, 13, 14], [8, 9, 10, 11, 12], 0.02, 0.2)
    assert rising[1] == 8 and all(s <= low for s, low in zip(rising[1:], [9, 10, 11, 12], strict=True))


def test_later_rows_change_nothing_and_symbols_are_apart(spark):
    rng = random.Random(6)
    x, y = ([rng.randint(1, 50) for _ in range(80)] for _ in range(2))
    long, short = bars(spark, close=x), bars(spark, close=x[:60])
    both = long.union(bars(spark, close=y, symbol="B"))
    for name in ("i04_rsi", "i08_supertrend", "i10_parabolic_sar", "i32_kvo", "i37_kst"):
        function, columns = I.REGISTRY[name]
        whole = values(function(long), *columns[:1])
        same(values(function(short), *columns[:1]), whole[:60])
        same(values(function(both).where("symbol = 'A'"), *columns[:1]), whole)


def test_periods_must_be_positive(spark):
    df = bars(spark, close=[1, 2])
    for wrong in (lambda: I.sma(df, 0), lambda: I.chaikin_oscillator(df, 3, 3), lambda: I.ultimate_oscillator(df, 3, 2, 4), lambda: I.kvo(df, slow=0)):
        with pytest.raises(ValueError):
            wrong()


def test_no_rows(spark):
    empty = bars(spark, close=[1]).where("false")
    for function, _ in I.REGISTRY.values():
        assert function(empty).count() == 0

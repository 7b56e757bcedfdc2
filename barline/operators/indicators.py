"""Technical indicators of all securities at once.

Each takes bars (symbol, date, open, high, low, close, volume) and returns them with new nullable columns. One
shuffle by symbol serves them all. Filter symbols before and dates after: an indicator needs its history.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import exponential, exponentials, highest, last_known, lowest, mean, positive, previous, rolling, row_number, running_product, running_sum, running_sums, total
from .parabolic import parabolic_sar

C = F.col


def _temporary(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def _ratio(a: Column, b: Column, zero: float | None = None) -> Column:
    """a / b, and ``zero`` where b is 0."""
    return F.when(b != 0, a / b).when(b == 0, F.lit(zero).cast("double"))


def _typical() -> Column:
    return (C("high") + C("low") + C("close")) / 3


def _true_range(df: DataFrame) -> DataFrame:
    df = df.withColumn("__pc", previous("close"))
    return df.withColumn("__tr", F.greatest(C("high") - C("low"), F.abs(C("high") - C("__pc")), F.abs(C("low") - C("__pc"))))


def _with_atr(df: DataFrame, period: int, out: str = "__atr") -> DataFrame:
    return _true_range(df).withColumn(out, mean("__tr", period))


def sma(df: DataFrame, period: int = 20) -> DataFrame:
    positive(period=period)
    return df.withColumn("sma", mean("close", period))


def ema(df: DataFrame, period: int = 20) -> DataFrame:
    positive(period=period)
    return exponential(df, "close", "ema", period, period - 1)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    positive(fast=fast, slow=slow, signal=signal)
    df = exponentials(df, [("close", "__fast", fast, fast - 1), ("close", "__slow", slow, slow - 1)])
    df = df.withColumn("macd", C("__fast") - C("__slow"))
    df = exponential(df, "macd", "signal", signal, max(fast, slow) + signal - 2)
    return _temporary(df.withColumn("histogram", C("macd") - C("signal")))


def rsi(df: DataFrame, period: int = 14) -> DataFrame:
    positive(period=period)
    df = df.withColumn("__d", C("close") - previous("close"))
    df = df.withColumns({"__gain": total(F.greatest("__d", F.lit(0.0)) + C("__d") * 0, period), "__loss": total(F.greatest(-C("__d"), F.lit(0.0)) + C("__d") * 0, period)})
    value = F.when(C("__loss") == 0, 100.0).otherwise(100 - 100 / (1 + _ratio(C("__gain"), C("__loss"))))
    return _temporary(df.withColumn("rsi", F.when(C("__loss").isNotNull(), value)))


def bollinger(df: DataFrame, period: int = 20, multiplier: float = 2.0) -> DataFrame:
    positive(period=period)
    df = df.withColumns({"middle": mean("close", period), "__sd": rolling(F.stddev_pop, "close", period)})
    return _temporary(df.withColumns({"upper": C("middle") + multiplier * C("__sd"), "lower": C("middle") - multiplier * C("__sd")}))


def atr(df: DataFrame, period: int = 14) -> DataFrame:
    positive(period=period)
    return _temporary(_with_atr(df, period, "atr"))


def adx(df: DataFrame, period: int = 14) -> DataFrame:
    """The unsmoothed directional index."""
    positive(period=period)
    df = _with_atr(df, period).withColumns({"__up": C("high") - previous("high"), "__down": previous("low") - C("low")})
    plus = F.when((C("__up") > C("__down")) & (C("__up") > 0), C("__up")).otherwise(0.0)
    minus = F.when((C("__down") > C("__up")) & (C("__down") > 0), C("__down")).otherwise(0.0)
    df = df.withColumns({"__plus": plus, "__minus": minus})
    df = df.withColumns({"__p": _ratio(total("__plus", period), C("__atr")), "__m": _ratio(total("__minus", period), C("__atr"))})
    return _temporary(df.withColumn("adx", _ratio(F.abs(C("__p") - C("__m")), C("__p") + C("__m")) * 100))


def supertrend(df: DataFrame, period: int = 10, multiplier: float = 3.0) -> DataFrame:
    """Begins at the lower band; a close above the value before gives the lower band, else the upper one.

    The next side depends on the present one only while the close lies between the bands before, and then it
    stays: the last known side, held.
    """
    positive(period=period, multiplier=multiplier)
    middle = (C("high") + C("low")) / 2
    df = _with_atr(df, period).withColumns({"__up": middle + multiplier * C("__atr"), "__low": middle - multiplier * C("__atr")})
    df = df.withColumns({"__pu": previous("__up"), "__pl": previous("__low")})
    side = F.when(C("__up").isNotNull() & C("__pu").isNull(), 1).when(C("close") > C("__pu"), 1).when(C("close") <= C("__pl"), 0)
    df = last_known(df.withColumn("__side", side), "__side", "__side")
    return _temporary(df.withColumn("supertrend", F.when(C("__side") == 1, C("__low")).otherwise(C("__up"))))


def stochastic(df: DataFrame, period: int = 14, signal: int = 3) -> DataFrame:
    positive(period=period, signal=signal)
    df = df.withColumns({"__hh": highest("high", period), "__ll": lowest("low", period)})
    df = df.withColumn("k", _ratio(C("close") - C("__ll"), C("__hh") - C("__ll"), 0.0) * 100)
    return _temporary(df.withColumn("d", mean("k", signal)))


def vwap(df: DataFrame) -> DataFrame:
    """From the first row on, without sessions."""
    df = running_sums(df.withColumn("__tpv", _typical() * C("volume")), {"__flow": "__tpv", "__volume": "volume"})
    return _temporary(df.withColumn("vwap", F.when(C("__volume") != 0, C("__flow") / C("__volume"))))


def obv(df: DataFrame) -> DataFrame:
    df = df.withColumn("__s", F.coalesce(F.signum(C("close") - previous("close")).cast("long") * C("volume"), F.lit(0)))
    return _temporary(running_sum(df, "__s", "__sum").withColumn("obv", C("__sum").cast("long")))


def mfi(df: DataFrame, period: int = 14) -> DataFrame:
    positive(period=period)
    df = df.withColumn("__tp", _typical()).withColumn("__ptp", previous("__tp"))
    flow = C("__tp") * C("volume")
    df = df.withColumns({"__in": F.when(C("__tp") > C("__ptp"), flow).otherwise(0.0), "__out": F.when(C("__tp") < C("__ptp"), flow).otherwise(0.0)})
    df = df.withColumns({"__in": total("__in", period), "__out": total("__out", period)})
    value = F.when(C("__out") == 0, 100.0).otherwise(100 - 100 / (1 + _ratio(C("__in"), C("__out"))))
    return _temporary(df.withColumn("mfi", F.when(C("__out").isNotNull(), value)))


def _money_flow(df: DataFrame) -> DataFrame:
    share = _ratio((C("close") - C("low")) - (C("high") - C("close")), C("high") - C("low"), 0.0)
    return df.withColumn("__mfv", share * C("volume"))


def cmf(df: DataFrame, period: int = 20) -> DataFrame:
    positive(period=period)
    return _temporary(_money_flow(df).withColumn("cmf", _ratio(total("__mfv", period), total("volume", period))))


def ichimoku(df: DataFrame) -> DataFrame:
    """Middles of 9, 26 and 52 rows; spans are not shifted."""
    middle = lambda p: (highest("high", p) + lowest("low", p)) / 2
    df = df.withColumns({"tenkan": middle(9), "kijun": middle(26), "span_b": middle(52)})
    return df.withColumn("span_a", (C("tenkan") + C("kijun")) / 2)


def donchian(df: DataFrame, period: int = 20) -> DataFrame:
    positive(period=period)
    df = df.withColumns({"upper": highest("high", period), "lower": lowest("low", period)})
    return df.withColumn("middle", (C("upper") + C("lower")) / 2)


def keltner(df: DataFrame, period: int = 20, multiplier: float = 2.0) -> DataFrame:
    positive(period=period)
    df = _with_atr(exponential(df, "close", "middle", period, period - 1), period)
    return _temporary(df.withColumns({"upper": C("middle") + multiplier * C("__atr"), "lower": C("middle") - multiplier * C("__atr")}))


def cci(df: DataFrame, period: int = 20) -> DataFrame:
    positive(period=period)
    df = df.withColumn("__tp", _typical()).withColumns({"__m": mean("__tp", period), "__all": rolling(F.collect_list, "__tp", period)})
    deviation = F.aggregate("__all", F.lit(0.0), lambda a, x: a + F.abs(x - C("__m"))) / period
    df = df.withColumn("__dev", deviation)
    return _temporary(df.withColumn("cci", _ratio(C("__tp") - C("__m"), 0.015 * C("__dev"), 0.0)))


def williams_r(df: DataFrame, period: int = 14) -> DataFrame:
    positive(period=period)
    df = df.withColumns({"__hh": highest("high", period), "__ll": lowest("low", period)})
    return _temporary(df.withColumn("williams_r", _ratio(C("__hh") - C("close"), C("__hh") - C("__ll"), 0.0) * -100 + 0.0))


def _change(rows: int, zero: float | None) -> Column:
    before = previous("close", rows)
    return _ratio(C("close") - before, before, zero) * 100


def roc(df: DataFrame, period: int = 12) -> DataFrame:
    positive(period=period)
    return df.withColumn("roc", _change(period, 0.0))


def ultimate_oscillator(df: DataFrame, short: int = 7, medium: int = 14, long: int = 28) -> DataFrame:
    positive(short=short)
    if not short <= medium <= long:
        raise ValueError("periods must not fall from short to long")
    df = df.withColumn("__pc", F.coalesce(previous("close"), C("close")))
    low, high = F.least("low", "__pc"), F.greatest("high", "__pc")
    df = df.withColumns({"__bp": C("close") - low, "__tr": high - low})
    df = df.withColumns({f"__r{k}": _ratio(total("__bp", p), total("__tr", p), 0.0) for k, p in enumerate((short, medium, long))})
    value = 100 * (4 * C("__r0") + 2 * C("__r1") + C("__r2")) / 7
    return _temporary(df.withColumn("ultimate_oscillator", F.when(row_number() >= long, value)))


def trix(df: DataFrame, period: int = 15) -> DataFrame:
    positive(period=period)
    for source, out in (("close", "__e1"), ("__e1", "__e2"), ("__e2", "__e3")):
        df = exponential(df, source, out, period, 0, seed_mean=False, before="__p" if out == "__e3" else None)
    return _temporary(df.withColumn("trix", _ratio(C("__e3") - C("__p"), C("__p"), 0.0) * 100))


def aroon(df: DataFrame, period: int = 25) -> DataFrame:
    """Rows since the earliest extreme of the window."""
    positive(period=period)
    df = df.withColumn("__n", row_number())
    high = rolling(F.max, F.struct("high", (-C("__n")).alias("n")), period)["n"]
    low = rolling(F.min, F.struct("low", C("__n").alias("n")), period)["n"]
    df = df.withColumns({"__h": C("__n") + high, "__l": C("__n") - low})
    return _temporary(df.withColumns({"aroon_up": (period - C("__h")) / period * 100, "aroon_down": (period - C("__l")) / period * 100}))


def aroon_oscillator(df: DataFrame, period: int = 25) -> DataFrame:
    return aroon(df, period).withColumn("aroon_oscillator", C("aroon_up") - C("aroon_down")).drop("aroon_up", "aroon_down")


def dpo(df: DataFrame, period: int = 20) -> DataFrame:
    positive(period=period)
    back = period // 2 + 1
    return df.withColumn("dpo", F.when(row_number() >= period - 1 + back, previous("close", back) - mean("close", period)))


def vortex(df: DataFrame, period: int = 14) -> DataFrame:
    positive(period=period)
    df = _true_range(df)
    df = df.withColumns({"__vp": F.abs(C("high") - previous("low")), "__vm": F.abs(C("low") - previous("high")), "__tr": F.when(C("__pc").isNotNull(), C("__tr"))})
    sums = total("__tr", period)
    return _temporary(df.withColumns({"vortex_plus": _ratio(total("__vp", period), sums), "vortex_minus": _ratio(total("__vm", period), sums)}))


def emv(df: DataFrame, period: int = 14) -> DataFrame:
    positive(period=period)
    middle = (C("high") + C("low")) / 2
    df = df.withColumn("__m", middle).withColumn("__move", C("__m") - previous("__m"))
    range_ = C("high") - C("low")
    df = df.withColumn("__e", F.when((range_ != 0) & (C("volume") != 0), C("__move") / (C("volume") / range_)))
    return _temporary(df.withColumn("emv", mean("__e", period)))


def accumulation_distribution(df: DataFrame) -> DataFrame:
    return _temporary(running_sum(_money_flow(df), "__mfv", "accumulation_distribution"))


def force_index(df: DataFrame) -> DataFrame:
    return df.withColumn("force_index", (C("close") - previous("close")) * C("volume"))


def _volume_index(df: DataFrame, out: str, base: float, rising: bool, ln: bool) -> DataFrame:
    """With ``ln`` the natural logarithm (``out``_ln), which long series need: their products leave the range of doubles. It is
    null from the first factor on that is not positive."""
    df = df.withColumns({"__pc": previous("close"), "__pv": previous("volume")})
    counts = ((C("volume") > C("__pv")) if rising else (C("volume") < C("__pv"))) & (C("__pc") != 0)
    if not ln:
        df = df.withColumn("__f", F.when(counts, 1 + (C("close") - C("__pc")) / C("__pc")).otherwise(1.0))
        return _temporary(running_product(df, "__f", "__p").withColumn(out, base * C("__p")))
    df = df.withColumn("__f", F.when(counts, C("close") / C("__pc")).otherwise(1.0))
    df = df.withColumn("__f", F.when(C("__f") > 0, F.log("__f")).when(C("__f") <= 0, float("-inf")))
    df = running_sum(df, "__f", "__p")
    return _temporary(df.withColumn(f"{out}_ln", F.when(C("__p") > float("-inf"), math.log(base) + C("__p"))))


def nvi(df: DataFrame, base: float = 1000.0, ln: bool = False) -> DataFrame:
    return _volume_index(df, "nvi", base, False, ln)


def pvi(df: DataFrame, base: float = 1000.0, ln: bool = False) -> DataFrame:
    return _volume_index(df, "pvi", base, True, ln)


def kvo(df: DataFrame, fast: int = 34, slow: int = 55, signal: int = 13) -> DataFrame:
    positive(fast=fast, slow=slow, signal=signal)
    df = df.withColumn("__s", C("high") + C("low") + C("close")).withColumn("__c", C("__s") - previous("__s"))
    sign = F.when(C("__c") > 0, 1).when(C("__c") < 0, -1)
    df = last_known(df.withColumn("__sign", sign), "__sign", "__last").withColumn("__trend", F.coalesce("__last", F.lit(1)))
    range_ = C("high") - C("low")
    force = C("volume") * C("__trend") * F.abs(2 * F.abs(C("__c")) / range_ - 1)
    df = df.withColumn("__vf", F.when((range_ != 0) & C("__c").isNotNull(), force).otherwise(0.0))
    df = exponentials(df, [("__vf", "__fast", fast, 0), ("__vf", "__slow", slow, 0)], seed_mean=False)
    df = exponential(df.withColumn("__kvo", C("__fast") - C("__slow")), "__kvo", "__sig", signal, 0, seed_mean=False)
    ready = row_number() >= slow - 1
    return _temporary(df.withColumns({"kvo": F.when(ready, C("__kvo")), "kvo_signal": F.when(ready, C("__sig"))}))


def chaikin_oscillator(df: DataFrame, fast: int = 3, slow: int = 10) -> DataFrame:
    positive(fast=fast, slow=slow)
    if fast >= slow:
        raise ValueError("fast must be less than slow")
    df = running_sum(_money_flow(df), "__mfv", "__ad")
    df = exponentials(df, [("__ad", "__fast", fast, fast - 1), ("__ad", "__slow", slow, slow - 1)])
    return _temporary(df.withColumn("chaikin_oscillator", C("__fast") - C("__slow")))


def elder_ray(df: DataFrame, period: int = 13) -> DataFrame:
    positive(period=period)
    df = exponential(df, "close", "__e", period, period - 1)
    return _temporary(df.withColumns({"bull_power": C("high") - C("__e"), "bear_power": C("low") - C("__e")}))


def rvi(df: DataFrame, period: int = 10) -> DataFrame:
    positive(period=period)
    return df.withColumn("rvi", _ratio(total(C("close") - C("open"), period), total(C("high") - C("low"), period)))


def coppock(df: DataFrame, long: int = 14, short: int = 11, wma: int = 10) -> DataFrame:
    positive(long=long, short=short, wma=wma)
    df = df.withColumn("__r", _change(long, None) + _change(short, None))
    weighted = sum((previous("__r", k) * (wma - k) for k in range(wma)), F.lit(0.0))
    return _temporary(df.withColumn("coppock", weighted / (wma * (wma + 1) / 2)))


def kst(df: DataFrame, rocs: tuple[int, ...] = (10, 15, 20, 30), smas: tuple[int, ...] = (10, 10, 10, 15)) -> DataFrame:
    positive(roc=min(rocs), sma=min(smas))
    df = df.withColumns({f"__r{k}": _change(p, None) for k, p in enumerate(rocs)})
    return _temporary(df.withColumn("kst", sum(((k + 1) * mean(f"__r{k}", p) for k, p in enumerate(smas)), F.lit(0.0))))


#: All indicators by number, with the columns they add.
REGISTRY: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "i01_sma": (sma, ("sma",)), "i02_ema": (ema, ("ema",)), "i03_macd": (macd, ("macd", "signal", "histogram")),
    "i04_rsi": (rsi, ("rsi",)), "i05_bollinger": (bollinger, ("middle", "upper", "lower")), "i06_atr": (atr, ("atr",)),
    "i07_adx": (adx, ("adx",)), "i08_supertrend": (supertrend, ("supertrend",)), "i09_stochastic": (stochastic, ("k", "d")),
    "i10_parabolic_sar": (parabolic_sar, ("psar",)), "i11_vwap": (vwap, ("vwap",)), "i12_obv": (obv, ("obv",)),
    "i13_mfi": (mfi, ("mfi",)), "i14_cmf": (cmf, ("cmf",)), "i15_ichimoku": (ichimoku, ("tenkan", "kijun", "span_a", "span_b")),
    "i16_donchian": (donchian, ("upper", "middle", "lower")), "i17_keltner": (keltner, ("middle", "upper", "lower")), "i18_cci": (cci, ("cci",)),
    "i19_williams_r": (williams_r, ("williams_r",)), "i20_roc": (roc, ("roc",)), "i21_ultimate_oscillator": (ultimate_oscillator, ("ultimate_oscillator",)),
    "i22_trix": (trix, ("trix",)), "i23_aroon": (aroon, ("aroon_up", "aroon_down")), "i24_aroon_oscillator": (aroon_oscillator, ("aroon_oscillator",)),
    "i25_dpo": (dpo, ("dpo",)), "i26_vortex": (vortex, ("vortex_plus", "vortex_minus")), "i27_emv": (emv, ("emv",)),
    "i28_accumulation_distribution": (accumulation_distribution, ("accumulation_distribution",)), "i29_force_index": (force_index, ("force_index",)),
    "i30_nvi": (nvi, ("nvi",)), "i31_pvi": (pvi, ("pvi",)), "i32_kvo": (kvo, ("kvo", "kvo_signal")),
    "i33_chaikin_oscillator": (chaikin_oscillator, ("chaikin_oscillator",)), "i34_elder_ray": (elder_ray, ("bull_power", "bear_power")),
    "i35_rvi": (rvi, ("rvi",)), "i36_coppock": (coppock, ("coppock",)), "i37_kst": (kst, ("kst",)),
}

"""Exit-policy grid: every trade re-simulated under 216 alternative entries
and exits (entry shift x exit mode x take-profit x stop-loss multiplier).

Plan: trades that enter one bar on one side share their results, so the grid
runs once per distinct entry (``units``) and its results are joined to the
trades at the end (``of_trades``), never sorted or ranked per trade. Every unit
is expanded to its entry shifts, and the bars that some entry uses are marked
by side before the bars are laid out (``mark``). Each
bar sees its next bars through ``lead`` over the shared (symbol, blk) window
(exact thanks to the halo), with the running trailing-stop level; bars that no
trade enters end there. For the others the first offsets at which each
take-profit / stop level is touched are found in the same partition, once per
bar and side (``exit_table``), so only these offsets are shuffled, not the
paths; the entries pick their bars' offsets; the 216-row scenario table (a
fixed-size parameter table) is broadcast-joined on the shift and each scenario
row only compares offsets. Ranking and the best policy work on groups of
exactly 216 rows per trade.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import ieee_div, rnd
from ..params import DEFAULT, Params
from ..plans.layout import Panel
from .labels import barrier_multipliers

SCENARIO_SCHEMA = T.StructType([
    T.StructField("scenario_id", T.LongType()),
    T.StructField("entry_shift", T.IntegerType()),
    T.StructField("exit_mode", T.StringType()),
    T.StructField("tp_mult", T.DoubleType()),
    T.StructField("sl_mult", T.DoubleType()),
    T.StructField("horizon", T.LongType()),
    T.StructField("trail", T.BooleanType()),
    T.StructField("m_tp_long", T.DoubleType()),
    T.StructField("m_sl_long", T.DoubleType()),
    T.StructField("m_tp_short", T.DoubleType()),
    T.StructField("m_sl_short", T.DoubleType()),
])


def horizon(mode: str, p: Params = DEFAULT) -> int:
    if mode.startswith("time_"):
        return int(mode.split("_")[1])
    return p.tp_sl_horizon if mode == "tp_sl" else p.trail_horizon


def scenario_rows(p: Params = DEFAULT) -> list[tuple]:
    """The grid in nesting order (shift, mode, tp, sl); scenario_id breaks pnl ties."""
    rows = []
    base_tp, base_sl = p.tp_pct, p.sl_pct
    for shift in p.entry_shifts:
        for mode in p.exit_modes:
            for tm in p.tp_mults:
                for sm in p.sl_mults:
                    tp_pct, sl_pct = base_tp * tm, base_sl * sm
                    ml = barrier_multipliers("long", tp_pct, sl_pct, p.cost)
                    ms = barrier_multipliers("short", tp_pct, sl_pct, p.cost)
                    rows.append((len(rows), shift, mode, float(tm), float(sm), horizon(mode, p),
                                 mode == "atr_trail", ml[0], ml[1], ms[0], ms[1]))
    return rows


def scenarios(spark: SparkSession, p: Params = DEFAULT) -> DataFrame:
    return spark.createDataFrame(scenario_rows(p), SCENARIO_SCHEMA)


SIDES = ("long", "short")
#: All that the results of a trade depend on: the bar it entered, the bars of its symbol, its side.
USE = ("symbol", "e", "n", "side")


def with_uses(trades: DataFrame, *keys: str) -> DataFrame:
    """One row per ``keys`` with ``uses``: the entries (``USE``) of its rows, in order, repeats included."""
    w = Window.partitionBy(*keys).orderBy(*USE)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    got = trades.select(*keys, F.collect_list(F.struct(*USE)).over(every).alias("uses"), F.row_number().over(w).alias("_k"))
    return got.filter("_k = 1").drop("_k")


def units(trades: DataFrame) -> DataFrame:
    """The distinct ``uses`` as trades: ``trade_id`` is the uses, one row for each of its entries.

    Trades that enter the same bar on the same side have the same results, so the grid is run once for them."""
    return trades.select(F.col("uses").alias("trade_id")).distinct().select("trade_id", F.inline("trade_id"))


def of_trades(trades: DataFrame, results: DataFrame) -> DataFrame:
    """``trades`` (with ``uses``) joined to the results of their units, each to all rows of its own."""
    return trades.join(results.withColumnRenamed("trade_id", "uses"), "uses").drop("uses")


def mark(bars_idx: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """Indexed bars with ``enter_long`` and ``enter_short``: whether an entry (symbol, entry_idx, side) uses the
    bar on that side. The entries are first brought to one row a bar, so a bar that many trades enter
    is joined once; halo copies made later carry the marks along."""
    used = entry_rows.groupBy("symbol", F.col("entry_idx").alias("rn")).agg(
        *[F.max(F.col("side") == side).alias(f"enter_{side}") for side in SIDES])
    marks = [F.coalesce(F.col(f"enter_{side}"), F.lit(False)).alias(f"enter_{side}") for side in SIDES]
    return bars_idx.join(used, ["symbol", "rn"], "left").select(*bars_idx.columns, *marks)


def with_forward(panel: Panel, p: Params = DEFAULT) -> Panel:
    """Each bar gets its next ``max_horizon`` bars as two arrays of structs (h, l, c, m).

    Of bars that ``mark`` has marked only the core bars that a trade enters are left, with the arrays of the
    sides on which they are entered (null for the other); unmarked bars all get both.

    ``fwd_long`` holds the bars as they are, with m = running max of the long
    trailing level (c - k*atr); ``fwd_short`` holds them mirrored (prices
    negated, high and low swapped) with m = running max of -(c + k*atr), so a
    short trade is evaluated as a long one on negated prices, exactly.
    Built from ``lead`` over the shared (symbol, blk) window: codegen'd, no
    per-row collections.
    """
    H = p.max_horizon()
    assert H <= p.halo_ahead and max(0, -min(p.entry_shifts)) <= p.halo_back, "halo must cover the grid"
    atr = F.coalesce(F.col("atr"), F.col("h") - F.col("l")) if "atr" in panel.df.columns else F.col("h") - F.col("l")
    mult = F.lit(p.trail_atr_mult)
    df = panel.df.withColumn("_tl", F.col("c") - mult * atr).withColumn("_ts", -(F.col("c") + mult * atr))
    # as SQL text: thousands of Column calls would take the driver longer than the job
    over = f"OVER (PARTITION BY {panel.key}, blk ORDER BY {panel.order})"
    steps = range(1, H + 1)
    df = df.selectExpr("*", *[f"lead({c}, {j}) {over} AS _{c}{j}" for j in steps for c in ("h", "l", "c", "_tl", "_ts")])

    def upto(c: str, j: int) -> str:
        return f"greatest({', '.join(f'_{c}{i}' for i in range(1, j + 1))})" if j > 1 else f"_{c}1"

    longs = ", ".join(f"struct(_h{j} AS h, _l{j} AS l, _c{j} AS c, {upto('_tl', j)} AS m)" for j in steps)
    shorts = ", ".join(f"struct(-_l{j} AS h, -_h{j} AS l, -_c{j} AS c, {upto('_ts', j)} AS m)" for j in steps)
    paths = [f"array({longs})", f"array({shorts})"]
    if "enter_long" in panel.df.columns:
        df = df.filter("core AND (enter_long OR enter_short)")
        paths = [f"CASE WHEN enter_{side} THEN {path} END" for side, path in zip(SIDES, paths)]
    keep = [F.col(c) for c in panel.df.columns]
    return panel.with_df(df.select(*keep, *[F.expr(path).alias(f"fwd_{side}") for side, path in zip(SIDES, paths)]))


def entries(trades: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per (trade, entry shift) with the clamped entry bar index.

    ``trades``: trade_id, symbol, side, e (entry bar rn), n, and any others.
    """
    shifts = F.array(*[F.lit(int(s)) for s in p.entry_shifts])
    t = trades.select("*", F.explode(shifts).alias("entry_shift"))
    t = t.withColumn("entry_idx", F.greatest(F.lit(0), F.least(F.col("e") + F.col("entry_shift"), F.col("n") - 2))
                     .cast("long"))
    return t


def exit_table(bars: DataFrame, p: Params = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """First barrier-touch offsets of every (symbol, entry bar, side) that has a path, and the columns ``carry`` of the bar.

    The barriers of a scenario depend only on the entry bar's close and the
    side, so trades sharing an entry bar share this work (a hot bar is
    computed once). ``bars``: symbol, rn, c, fwd_long, fwd_short; nothing is
    shuffled here, the paths end where the offsets are found.
    For each take-profit level i: ``_T{i}`` (offset of first high >= level);
    for each stop level: ``_S{i}`` (fixed stop), ``_R{i}`` (ratcheting stop)
    and ``_Rm{i}`` (trailing level at that bar); ``_C{h}``: close at horizon h.
    Offsets are 1-based, null when not touched within the path.
    """
    k = p.cost
    H = p.max_horizon()
    tp_levels, sl_levels = list(p.tp_mults), list(p.sl_mults)
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"fwd_{side}").alias("fwd")) for side in SIDES])
    e = bars.select("symbol", F.col("rn").alias("entry_idx"), F.col("c").alias("entry_price"), *carry, F.inline(sides))
    e = e.filter("fwd IS NOT NULL")
    long = F.col("side") == "long"
    sgn = F.when(long, F.lit(1.0)).otherwise(F.lit(-1.0))
    ep = F.col("entry_price")
    fwd = F.col("fwd")
    cols = []
    for i, tm in enumerate(tp_levels):
        ml = barrier_multipliers("long", p.tp_pct * tm, p.sl_pct, k)[0]
        ms = barrier_multipliers("short", p.tp_pct * tm, p.sl_pct, k)[0]
        cols.append((sgn * (ep * F.when(long, F.lit(ml)).otherwise(F.lit(ms)))).alias(f"_tp{i}"))
    for i, sm in enumerate(sl_levels):
        ml = barrier_multipliers("long", p.tp_pct, p.sl_pct * sm, k)[1]
        ms = barrier_multipliers("short", p.tp_pct, p.sl_pct * sm, k)[1]
        cols.append((sgn * (ep * F.when(long, F.lit(ml)).otherwise(F.lit(ms)))).alias(f"_sl{i}"))
    e = e.select("*", *cols)
    hits = [_first(f"{{bar}}.h >= _tp{i}", H).alias(f"_T{i}") for i in range(len(tp_levels))]
    for i in range(len(sl_levels)):
        hits.append(_first(f"{{bar}}.l <= _sl{i}", H).alias(f"_S{i}"))
        hits.append(_first(f"{{bar}}.l <= greatest(_sl{i}, {{bar}}.m)", H).alias(f"_R{i}"))
    e = e.select("*", *hits)
    horizons = sorted({int(x[5]) for x in scenario_rows(p)})
    at = [F.get(fwd, F.col(f"_R{i}") - 1)["m"].alias(f"_Rm{i}") for i in range(len(sl_levels))]
    at += [F.get(fwd, F.lit(hz - 1))["c"].alias(f"_C{hz}") for hz in horizons]
    return e.select(*[c for c in e.columns if c != "fwd"], *at)


def _first(condition: str, H: int):
    """1-based offset of the first forward bar satisfying the SQL ``condition`` on ``{bar}``, null if none."""
    return F.expr("CASE " + " ".join(f"WHEN {condition.format(bar=f'fwd[{j}]')} THEN {j + 1}" for j in range(H)) + " END")


def evaluate(entry_rows: DataFrame, bars: DataFrame, scen: DataFrame, p: Params = DEFAULT,
             partitions: int | None = None, carry: tuple[str, ...] = (), carry_bar: tuple[str, ...] = ()) -> DataFrame:
    """One row per (trade, scenario): exit index, price, reason, pnl, bars held,
    the columns ``carry`` of the trade and the columns ``carry_bar`` of its entry bar.

    Barriers stay live in every mode; the stop ratchets in ``atr_trail``
    (updated with the bar's close before its low is tested); at the horizon
    bar the trade exits at the close ('time'); if the bars run out first it
    exits at the entry price ('timeout', 0 bars); take profit is tested before
    stop loss, both before the horizon close. Each scenario row only picks
    its levels' first-touch offsets from ``exit_table`` and compares them.
    """
    k = p.cost
    tp_levels, sl_levels = list(p.tp_mults), list(p.sl_mults)
    horizons = sorted({int(x[5]) for x in scenario_rows(p)})
    ex = exit_table(bars, p, carry_bar)
    carry = (*carry, *carry_bar)
    sc = scen.select(
        "*",
        (F.array_position(F.array(*[F.lit(float(x)) for x in tp_levels]), F.col("tp_mult")) - 1).cast("int")
        .alias("_ti"),
        (F.array_position(F.array(*[F.lit(float(x)) for x in sl_levels]), F.col("sl_mult")) - 1).cast("int")
        .alias("_si"),
        (F.array_position(F.array(*[F.lit(hz) for hz in horizons]), F.col("horizon")) - 1).cast("int")
        .alias("_hi"),
    )
    g = entry_rows.join(ex, ["symbol", "entry_idx", "side"])
    # the scenario rows are CPU work: spread them by trade over an explicit
    # partition count (an explicit count is not coalesced away by AQE); the
    # per-trade ranking / best policy downstream reuse this partitioning
    g = g.repartition(partitions, "trade_id") if partitions else g.repartition("trade_id")
    g = g.join(F.broadcast(sc), "entry_shift")
    long = F.col("side") == "long"
    sgn = F.when(long, F.lit(1.0)).otherwise(F.lit(-1.0))
    ep = F.col("entry_price")

    def pick(prefix, idx, names):
        return F.get(F.array(*[F.col(f"{prefix}{x}") for x in names]), F.col(idx))

    nt, ns = range(len(tp_levels)), range(len(sl_levels))
    big = F.lit(1 << 30)
    trail = F.col("trail")
    g = g.select(
        "trade_id", "scenario_id", "entry_shift", "exit_mode", "tp_mult", "sl_mult", "entry_idx", "entry_price",
        "side", *[c for c in carry if c != "side"],
        F.coalesce(pick("_T", "_ti", nt), big).alias("_t"),
        F.coalesce(F.when(trail, pick("_R", "_si", ns)).otherwise(pick("_S", "_si", ns)), big).alias("_s"),
        F.col("horizon").cast("int").alias("_h"),
        pick("_tp", "_ti", nt).alias("_tpx"),
        F.when(trail, F.greatest(pick("_sl", "_si", ns), pick("_Rm", "_si", ns)))
        .otherwise(pick("_sl", "_si", ns)).alias("_spx"),
        pick("_C", "_hi", horizons).alias("_hc"),
    )
    t, s_, h = F.col("_t"), F.col("_s"), F.col("_h")
    res_t = "struct<off:int,why:string,px:double>"

    def res(off, why, px):
        return F.struct(off.alias("off"), F.lit(why).alias("why"), px.cast("double").alias("px"))

    res = (
        F.when((t <= s_) & (t <= h), res(t, "tp", sgn * F.col("_tpx")))
        .when(s_ <= h, res(s_, "sl", sgn * F.col("_spx")))
        .when(F.col("_hc").isNotNull(), res(h, "time", sgn * F.col("_hc")))
        .otherwise(res(F.lit(0), "timeout", ep))
        .cast(res_t)
    )
    g = g.withColumn("_r", res)
    exit_px = F.col("_r.px")
    pnl = F.when(long, ieee_div(exit_px - ep, ep) - F.lit(k)).otherwise(ieee_div(ep - exit_px, ep) - F.lit(k))
    exit_idx = F.col("entry_idx") + F.col("_r.off")
    return g.select(
        "trade_id", "scenario_id", "entry_shift", "exit_mode", "tp_mult", "sl_mult",
        F.col("entry_idx").cast("long").alias("entry_idx"), "entry_price",
        exit_idx.cast("long").alias("exit_idx"), exit_px.alias("exit_price"), F.col("_r.why").alias("exit_reason"),
        pnl.alias("pnl_pct"), F.col("_r.off").cast("long").alias("bars_held"), *carry,
    )


def ranked(results: DataFrame) -> DataFrame:
    """Rank within each trade by pnl descending; ties keep grid order (scenario_id)."""
    w = Window.partitionBy("trade_id").orderBy(F.col("pnl_pct").desc(), F.col("scenario_id"))
    return results.withColumn("rank", F.row_number().over(w).cast("long"))


def top_k(results: DataFrame, k: int = 10) -> DataFrame:
    return ranked(results).filter(F.col("rank") <= k)


def best(results: DataFrame) -> DataFrame:
    """The best scenario of each trade (a 216-row hash aggregate per trade, no sort)."""
    cols = [c for c in results.columns if c != "trade_id"]
    key = F.struct(F.col("pnl_pct"), (-F.col("scenario_id")).alias("neg_id"))
    agg = results.groupBy("trade_id").agg(F.max_by(F.struct(*cols), key).alias("_b"))
    return agg.select("trade_id", *[F.col("_b")[c].alias(c) for c in cols])


def best_policy_of(results: DataFrame, *keys: str, digits: int = 10, weight: str | None = None) -> DataFrame:
    """The scenario with the highest mean pnl over all trades of each of ``keys`` (means rounded to ``digits``
    places, so that equal ones are equal; ties to the first scenario), with ``mean_pnl`` and ``trades``.
    A row of ``results`` stands for as many trades as its column ``weight`` says (none: one).

    Trades are first brought to one row for each of keys and scenario, so a hot key is at most 216 rows."""
    policy = ["scenario_id", "exit_mode", "entry_shift", "tp_mult", "sl_mult"]
    mean, trades = F.avg("pnl_pct"), F.count(F.lit(1))
    if weight:
        mean, trades = F.sum(F.col("pnl_pct") * F.col(weight)) / F.sum(F.when(F.col("pnl_pct").isNotNull(), F.col(weight))), F.sum(weight)
    means = results.groupBy(*keys, *policy).agg(rnd(mean, digits).alias("mean_pnl"), trades.alias("trades"))
    key = F.struct(F.col("mean_pnl"), (-F.col("scenario_id")).alias("neg_id"))
    best_row = means.groupBy(*keys).agg(F.max_by(F.struct(*policy, "mean_pnl", "trades"), key).alias("_b"))
    return best_row.select(*keys, "_b.*")


def actual_and_best(results: DataFrame, base: int, carry: tuple[str, ...] = (), carry_bar: tuple[str, ...] = ()) -> DataFrame:
    """One row per trade, from one aggregate of its scenarios: trade_id, ``carry``, the structs
    ``actual`` (scenario ``base``, with the columns ``carry_bar``) and ``best`` (highest pnl, ties to the
    first scenario)."""
    cols = [c for c in results.columns if c not in ("trade_id", *carry, *carry_bar)]
    key = F.struct(F.col("pnl_pct"), (-F.col("scenario_id")).alias("neg_id"))
    agg = results.groupBy("trade_id", *carry).agg(
        F.max(F.when(F.col("scenario_id") == base, F.struct(*cols, *carry_bar))).alias("actual"),
        F.max_by(F.struct(*cols), key).alias("best"))
    return agg.filter("actual is not null")


def delta_r(actual_pnl, best_pnl, risk: float = 1.0):
    """best/risk - actual/risk."""
    return best_pnl / F.lit(risk) - actual_pnl / F.lit(risk)

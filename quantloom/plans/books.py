"""Queries of portfolio, risk, board, allocation, scenarios, lots and taxes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions import numeric
from quantloom.operators import backtest, portfolio
from quantloom.sources import scratch

from . import views
from .catalog import LATEST, W1, query, r, rounded
from .technical import SIGNALS, _signal, signal_rows

VALUED = """v0 AS (SELECT q.symbol, quantity, average_price, invested_amount, l.close AS price, quantity * l.close AS value, asset_type, currency, risk_level FROM positions q LEFT JOIN latest l USING (symbol) LEFT JOIN assets USING (symbol)),
    v1 AS (SELECT *, value * 100 / (sum(value) OVER () + (SELECT cash FROM money)) AS weight FROM v0), valued AS (SELECT *, sum(weight) OVER (PARTITION BY asset_type) AS class_weight FROM v1)"""
BOOK = ("prices", "positions", "assets", "money")


def valued(spark, sf, bars=None):
    return portfolio.value(views.positions(spark, sf), portfolio.latest(views.prices(spark, sf) if bars is None else bars), views.assets(spark, sf), views.cash(spark, sf))


@query("portfolio_valuation", f"WITH {LATEST}, {VALUED} SELECT symbol, asset_type, round(value, 2) AS value, round(value - invested_amount, 4) AS unrealized, round((value - invested_amount) * 100 / nullif(invested_amount, 0), 4) AS unrealized_percent, round(weight, 4) AS weight, round(class_weight, 4) AS class_weight FROM valued", *BOOK)
def portfolio_valuation(spark, sf):
    return valued(spark, sf).select("symbol", "asset_type", F.round("value", 2).alias("value"), *[F.round(c, 4).alias(c) for c in ("unrealized", "unrealized_percent", "weight", "class_weight")])


@query("portfolio_summary", f"WITH {LATEST}, {VALUED} SELECT cash, round(sum(value), 2) AS invested, round(sum(value) + cash, 2) AS total, round(sum(value - invested_amount), 2) AS unrealized, count(*) AS positions FROM valued, money GROUP BY cash", *BOOK)
def portfolio_summary(spark, sf):
    out = portfolio.summary(valued(spark, sf), views.cash(spark, sf), F.lit(100_000.0))
    return out.select("cash", *[F.round(c, 2).alias(c) for c in ("invested", "total", "unrealized")], "positions")


@query("portfolio_shares", f"WITH {LATEST}, {VALUED} SELECT 'asset_type' AS kind, asset_type AS name, round(sum(weight), 4) AS share FROM valued GROUP BY asset_type UNION ALL SELECT 'currency', currency, round(sum(weight), 4) FROM valued GROUP BY currency", *BOOK)
def portfolio_shares(spark, sf):
    rows = valued(spark, sf).select("weight", F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in ("asset_type", "currency")])))
    return rows.groupBy("kind", "name").agg(F.round(F.sum("weight"), 4).alias("share"))


ADVICE = f"""g AS (SELECT *, {_signal('score')} AS signal FROM signals), cw AS (SELECT asset_type, sum(weight) AS class_weight FROM valued GROUP BY asset_type),
    w AS (SELECT a.symbol, a.asset_type, a.risk_level, coalesce(v.weight, 0) AS weight, coalesce(cw.class_weight, 0) AS class_weight, g.signal, g.score FROM assets a LEFT JOIN valued v USING (symbol) LEFT JOIN cw ON cw.asset_type = a.asset_type LEFT JOIN g USING (symbol)),
    advice AS (SELECT *, CASE WHEN weight >= 25 THEN 'BLOCK_BUY_TOO_CONCENTRATED' WHEN class_weight >= 50 THEN 'BLOCK_BUY_TOO_CONCENTRATED' WHEN asset_type = 'crypto' AND class_weight >= 15 THEN 'BLOCK_BUY_HIGH_RISK'
        WHEN risk_level IN ('high', 'very_high') AND NOT coalesce(signal IN ('STRONG_BUY', 'BUY'), FALSE) THEN 'BLOCK_BUY_HIGH_RISK' WHEN signal = 'SELL' THEN 'SELL' WHEN signal = 'REDUCE' THEN 'REDUCE'
        WHEN signal IN ('STRONG_BUY', 'BUY') AND weight < 20 THEN 'BUY_ALLOWED' ELSE 'HOLD' END AS recommendation FROM w)"""
ALL = (*BOOK, "news")


def advised(spark, sf):
    """Positions at their value and what to do about every asset, each a small table written once: lists and board read them several times."""
    bars = scratch.keep(views.prices(spark, sf), "bars")
    held = valued(spark, sf, bars)
    return held, scratch.keep(portfolio.recommend(held, signal_rows(spark, sf, bars), views.assets(spark, sf)), "advised")


@query("recommendations", f"WITH RECURSIVE {LATEST}, {VALUED}, {SIGNALS}, {ADVICE} SELECT symbol, signal, score, round(weight, 4)::DOUBLE AS weight, recommendation FROM advice", *ALL)
def recommendations(spark, sf):
    return advised(spark, sf)[1].select("symbol", "signal", "score", F.round("weight", 4).alias("weight"), "recommendation")


WARNED = """share AS (SELECT cash * 100 / (cash + (SELECT coalesce(sum(value), 0) FROM valued)) AS value FROM money),
    warned AS (SELECT 'WARNING' AS level, 'SINGLE_ASSET_CONCENTRATION' AS code, symbol AS subject, weight AS value FROM valued WHERE weight > 25
    UNION ALL SELECT 'WARNING', 'WEAK_SIGNAL_OVERWEIGHT', symbol, weight FROM valued JOIN g USING (symbol) WHERE weight > 12 AND signal IN ('SELL', 'REDUCE')
    UNION ALL SELECT 'WARNING', 'ASSET_CLASS_CONCENTRATION', asset_type, class_weight FROM cw WHERE class_weight > 50
    UNION ALL SELECT 'WARNING', 'CRYPTO_OVERWEIGHT', NULL, class_weight FROM cw WHERE asset_type = 'crypto' AND class_weight > 15
    UNION ALL SELECT 'INFO', 'HIGH_CASH', NULL, value FROM share WHERE value > 35 UNION ALL SELECT 'WARNING', 'LOW_CASH', NULL, value FROM share WHERE value < 2
    UNION ALL SELECT 'WARNING', 'TOP_THREE_CONCENTRATION', NULL, t3 FROM (SELECT sum(weight) AS t3 FROM (SELECT weight FROM valued ORDER BY weight DESC NULLS LAST LIMIT 3)) WHERE t3 > 70)"""


@query("risk_warnings", f"WITH RECURSIVE {LATEST}, {VALUED}, {SIGNALS}, {ADVICE}, {WARNED} SELECT level, code, subject, round(value, 4) AS value FROM warned", *ALL)
def risk_warnings(spark, sf):
    bars = scratch.keep(views.prices(spark, sf), "bars")
    return portfolio.warnings(valued(spark, sf, bars), signal_rows(spark, sf, bars), views.cash(spark, sf)).withColumn("value", F.round("value", 4))


BOARD = f"""acts AS (SELECT CASE WHEN weight > 0 AND signal = 'SELL' THEN 'SELL' WHEN weight > 0 AND signal = 'REDUCE' THEN 'REDUCE' WHEN weight <= 0 AND recommendation = 'BUY_ALLOWED' THEN 'BUY' END AS kind, * FROM advice),
    ranked AS (SELECT kind, CASE WHEN kind = 'SELL' OR (kind = 'BUY' AND (signal = 'STRONG_BUY' OR score >= 75)) THEN 'HIGH' ELSE 'MEDIUM' END AS priority, symbol, recommendation AS code, score, weight, row_number() OVER (PARTITION BY kind ORDER BY score DESC NULLS LAST, symbol) AS k FROM acts WHERE kind IS NOT NULL),
    b0 AS (SELECT kind, priority, symbol, code, score, round(weight, 4)::DOUBLE AS weight FROM ranked WHERE kind <> 'BUY' OR k <= 6 UNION ALL SELECT 'RISK', CASE level WHEN 'WARNING' THEN 'HIGH' ELSE 'LOW' END, subject, code, NULL, NULL FROM warned),
    board AS (SELECT * FROM b0 UNION ALL SELECT 'OK', 'LOW', NULL, 'NOTHING_URGENT', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM b0))"""


def acted(spark, sf):
    held, rows = advised(spark, sf)
    return portfolio.board(rows, portfolio.warnings(held, rows.select("symbol", "signal"), views.cash(spark, sf)))


@query("action_board", f"WITH RECURSIVE {LATEST}, {VALUED}, {SIGNALS}, {ADVICE}, {WARNED}, {BOARD} SELECT kind, priority, symbol, code, score, weight, CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END::INT AS rank FROM board", *ALL)
def action_board(spark, sf):
    return acted(spark, sf).withColumn("weight", F.round("weight", 4))


@query("action_counts", f"WITH RECURSIVE {LATEST}, {VALUED}, {SIGNALS}, {ADVICE}, {WARNED}, {BOARD} SELECT count_if(kind = 'BUY')::BIGINT AS buy, count_if(kind = 'REDUCE')::BIGINT AS reduce, count_if(kind = 'SELL')::BIGINT AS sell, count_if(kind = 'RISK')::BIGINT AS risk FROM board", *ALL)
def action_counts(spark, sf):
    return portfolio.headline(acted(spark, sf))


@query("asset_list", f"WITH RECURSIVE {LATEST}, {SIGNALS} SELECT a.symbol, a.name, a.asset_type, a.currency, a.risk_level, l.close AS last_price, l.date AS last_price_date, round((l.close - previous_close) / nullif(previous_close, 0) * 100, 4) AS daily_change, s.score, s.technical_score, {_signal('s.score')} AS signal, s.news_label, s.news_impact FROM assets a LEFT JOIN latest l USING (symbol) LEFT JOIN signals s USING (symbol)", "prices", "assets", "news")
def asset_list(spark, sf):
    bars = scratch.keep(views.prices(spark, sf), "bars")
    latest = portfolio.latest(bars).select("symbol", F.col("close").alias("last_price"), F.col("date").alias("last_price_date"), F.round("change_percent", 4).alias("daily_change"))
    rows = views.assets(spark, sf).join(latest, "symbol", "left").join(signal_rows(spark, sf, bars).drop("news_count", "news_score"), "symbol", "left")
    return rows.select("symbol", "name", "asset_type", "currency", "risk_level", "last_price", "last_price_date", "daily_change", "score", "technical_score", "signal", "news_label", "news_impact")


@query("position_list", f"WITH RECURSIVE {LATEST}, {VALUED}, {SIGNALS}, {ADVICE} SELECT v.symbol, v.quantity, round(v.average_price, 2) AS average_price, round(v.value, 2) AS value, round(v.weight, 2) AS weight, v.currency, advice.signal, advice.recommendation FROM valued v LEFT JOIN advice USING (symbol)", *ALL)
def position_list(spark, sf):
    held, told = advised(spark, sf)
    rows = held.join(told.select("symbol", "signal", "recommendation"), "symbol", "left")
    return rows.select("symbol", "quantity", *[F.round(c, 2).alias(c) for c in ("average_price", "value", "weight")], "currency", "signal", "recommendation")


@query("order_list", """SELECT symbol, side AS order_type, quantity, price, fees, round(price * quantity, 2) AS gross_amount, round(price * quantity + CASE WHEN side = 'BUY' THEN fees ELSE -fees END, 2) AS net_amount, order_date FROM trades""", "trades")
def order_list(spark, sf):
    gross = F.col("price") * F.col("quantity")
    return views.orders(spark, sf).select("symbol", F.col("side").alias("order_type"), "quantity", "price", "fees", F.round(gross, 2).alias("gross_amount"), F.round(gross + F.when(F.col("side") == "BUY", F.col("fees")).otherwise(-F.col("fees")), 2).alias("net_amount"), "order_date")


@query("dashboard", f"WITH RECURSIVE {SIGNALS} SELECT (SELECT count(*) FROM assets) AS assets_count, (SELECT count(*) FROM positions) AS positions_count, (SELECT count(*) FROM prices) AS price_points, count(*) AS signals_count, round(avg(score), 2) AS average_score FROM signals", "prices", "positions", "assets", "news")
def dashboard(spark, sf):
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    rows = signal_rows(spark, sf).agg(F.count(F.lit(1)).alias("signals_count"), F.round(F.avg("score"), 2).alias("average_score"))
    return rows.select(count(views.assets(spark, sf)).alias("assets_count"), count(views.positions(spark, sf)).alias("positions_count"), count(views.prices(spark, sf)).alias("price_points"), "signals_count", "average_score")


@query("dashboard_leaders", f"""WITH RECURSIVE {SIGNALS}, x AS (SELECT symbol, score, CASE risk_level WHEN 'very_high' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS risk FROM assets JOIN signals USING (symbol)),
    y AS (SELECT *, row_number() OVER (ORDER BY score DESC, symbol) AS a, row_number() OVER (ORDER BY score, symbol DESC) AS b, row_number() OVER (ORDER BY risk DESC, score DESC, symbol) AS c FROM x)
    SELECT 'top' AS list, a::INT AS place, symbol, score FROM y WHERE a <= 5 UNION ALL SELECT 'weakest', b::INT, symbol, score FROM y WHERE b <= 5 UNION ALL SELECT 'risky', c::INT, symbol, score FROM y WHERE c <= 5""", "prices", "assets", "news")
def dashboard_leaders(spark, sf):
    rows = signal_rows(spark, sf).select("symbol", "score").join(views.assets(spark, sf).select("symbol", "risk_level"), "symbol")
    risk = numeric.ordinal(F.col("risk_level"), "medium", "high", "very_high")
    lists = {"top": [F.desc("score"), F.asc("symbol")], "weakest": [F.asc("score"), F.desc("symbol")], "risky": [F.desc(risk), F.desc("score"), F.asc("symbol")]}
    parts = [rows.orderBy(*o).limit(5).withColumn("place", F.row_number().over(W.orderBy(*o))).select(F.lit(n).alias("list"), "place", "symbol", "score") for n, o in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LATE = f"late AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM prices), rets AS (SELECT *, close / lag(close) OVER {W1} - 1 AS ret FROM late WHERE k <= 120), vol AS (SELECT symbol, coalesce(stddev_samp(ret), 0) * sqrt(252) AS volatility FROM rets GROUP BY symbol)"
ALLOC = f"""{LATE}, a0 AS (SELECT symbol, volatility, 1 / (count(*) OVER ())::DOUBLE AS equal, CASE WHEN volatility > 1e-6 THEN 1 / volatility ELSE 0 END AS inv, greatest(coalesce(score, 0) - 50, 0) AS above FROM vol JOIN signals USING (symbol)),
    a1 AS (SELECT *, coalesce(inv / nullif(sum(inv) OVER (), 0), equal) AS risk_parity, coalesce(above / nullif(sum(above) OVER (), 0), equal) AS score_weighted FROM a0)"""


def allocated(spark, sf, most=None):
    bars = scratch.keep(views.prices(spark, sf), "bars")
    return portfolio.allocate(bars, signal_rows(spark, sf, bars), most=most)


@query("allocation", f"WITH RECURSIVE {SIGNALS}, {ALLOC} SELECT symbol, {r('volatility equal risk_parity score_weighted')}, round(risk_parity * least(1, coalesce(.15 / nullif(sum(risk_parity * volatility) OVER (), 0), 1)), 5) AS vol_target FROM a1", "prices", "assets", "news")
def allocation(spark, sf):
    return rounded(allocated(spark, sf), "symbol", "volatility", "equal", "risk_parity", "score_weighted", "vol_target")


CAP = 0.06


@query("allocation_capped", f"""WITH RECURSIVE {SIGNALS}, {ALLOC}, l AS (SELECT symbol, unnest(['risk_parity', 'score_weighted']) AS method, unnest([risk_parity, score_weighted]) AS w FROM a1),
    capped AS (SELECT *, sum(greatest(w - {CAP}, 0)) OVER (PARTITION BY method) AS excess, sum(greatest({CAP} - w, 0)) OVER (PARTITION BY method) AS room, count(*) OVER (PARTITION BY method) AS n FROM l)
    SELECT symbol, method, round(CASE WHEN {CAP} * n < 1 - 1e-9 THEN w WHEN w >= {CAP} THEN {CAP} ELSE w + coalesce(excess / nullif(room, 0), 0) * ({CAP} - w) END, 5)::DOUBLE AS weight FROM capped""", "prices", "assets", "news")
def allocation_capped(spark, sf):
    rows = allocated(spark, sf, CAP)
    return rows.select("symbol", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.round(m, 5).alias("weight")) for m in ("risk_parity", "score_weighted")])))


@query("allocation_quantities", f"WITH RECURSIVE {SIGNALS}, {LATEST}, {ALLOC} SELECT symbol, round(1e6 * equal, 2) AS capital, l.close AS price, floor(1e6 * equal / l.close)::BIGINT AS quantity FROM a1 JOIN latest l USING (symbol)", "prices", "assets", "news")
def allocation_quantities(spark, sf):
    out = portfolio.plan_quantities(allocated(spark, sf), portfolio.latest(views.prices(spark, sf)), "equal", 1e6)
    return out.select("symbol", F.round("capital", 2).alias("capital"), "price", "quantity")


# Shocks in percent as the scenarios have them, written out again for the SQL.
SHOCKS = """z(scenario, kind, shock) AS (VALUES ('MARKET_CRASH', 'stock', -25.0), ('MARKET_CRASH', 'etf', -22), ('MARKET_CRASH', 'crypto', -45), ('MARKET_CRASH', 'bond', -3), ('MARKET_CRASH', 'bond_etf', -5),
    ('TECH_SELLOFF', 'stock', -18), ('TECH_SELLOFF', 'etf', -12), ('TECH_SELLOFF', 'crypto', -25), ('TECH_SELLOFF', 'bond', 1), ('TECH_SELLOFF', 'bond_etf', 0),
    ('CRYPTO_WINTER', 'stock', -3), ('CRYPTO_WINTER', 'etf', -2), ('CRYPTO_WINTER', 'crypto', -55), ('CRYPTO_WINTER', 'bond', 0), ('CRYPTO_WINTER', 'bond_etf', 0),
    ('RATE_HIKE', 'stock', -8), ('RATE_HIKE', 'etf', -7), ('RATE_HIKE', 'crypto', -15), ('RATE_HIKE', 'bond', -12), ('RATE_HIKE', 'bond_etf', -10),
    ('INFLATION_SHOCK', 'stock', -10), ('INFLATION_SHOCK', 'etf', -9), ('INFLATION_SHOCK', 'crypto', -20), ('INFLATION_SHOCK', 'bond', -8), ('INFLATION_SHOCK', 'bond_etf', -7),
    ('MILD_CORRECTION', 'stock', -7), ('MILD_CORRECTION', 'etf', -6), ('MILD_CORRECTION', 'crypto', -12), ('MILD_CORRECTION', 'bond', -1), ('MILD_CORRECTION', 'bond_etf', -2)),
    hit AS (SELECT z.scenario, v.symbol, v.asset_type AS kind, v.value, greatest(v.value + v.value * shock::DOUBLE / 100, 0) AS stressed FROM valued v JOIN z ON z.kind = v.asset_type)"""


@query("scenario_crash", f"WITH {LATEST}, {VALUED}, {SHOCKS} SELECT kind AS asset_type, round(sum(value), 2) AS value, round(sum(stressed), 4) AS stressed FROM hit WHERE scenario = 'MARKET_CRASH' GROUP BY kind", *BOOK)
def scenario_crash(spark, sf):
    out = portfolio.stress(valued(spark, sf), portfolio.SCENARIOS["MARKET_CRASH"])
    return out.select("asset_type", F.round("value", 2).alias("value"), F.round("stressed", 4).alias("stressed"))


@query("scenario_presets", f"""WITH {LATEST}, {VALUED}, {SHOCKS}, k AS (SELECT scenario, kind, sum(value) AS value, sum(stressed) - sum(value) AS impact FROM hit GROUP BY scenario, kind),
    kk AS (SELECT scenario, arg_min(kind, (impact, kind)) AS worst, min(impact) AS least_impact, coalesce(sum(value) FILTER (WHERE kind = 'crypto'), 0) AS crypto FROM k GROUP BY scenario),
    s AS (SELECT scenario, sum(value) + (SELECT cash FROM money) AS value, sum(floor(stressed * 100 + .5::DOUBLE) / 100) + (SELECT cash FROM money) AS stressed FROM hit GROUP BY scenario), p AS (SELECT *, round((stressed - value) * 100 / value, 2) AS loss_percent FROM s)
    SELECT scenario, round(value, 2) AS value, round(stressed, 2) AS stressed, loss_percent, CASE WHEN loss_percent <= -25 THEN 'EXTREME' WHEN loss_percent <= -15 THEN 'HIGH' WHEN loss_percent <= -5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    array_to_string(list_filter([CASE WHEN loss_percent <= -15 THEN 'REDUCE_RISK' END, CASE WHEN crypto / value > .15 THEN 'TRIM_CRYPTO' END, CASE WHEN (SELECT cash FROM money) * 100 / value < 5 THEN 'RAISE_CASH' END, CASE WHEN least_impact < 0 THEN 'DIVERSIFY:' || worst END,
    CASE WHEN loss_percent > -15 AND crypto / value <= .15 AND (SELECT cash FROM money) * 100 / value >= 5 AND least_impact >= 0 THEN 'NONE_URGENT' END], lambda x: x IS NOT NULL), ',') AS tips FROM p JOIN kk USING (scenario)""", *BOOK)
def scenario_presets(spark, sf):
    return portfolio.scenarios(valued(spark, sf), views.cash(spark, sf)).select("scenario", F.round("value", 2).alias("value"), F.round("stressed", 2).alias("stressed"), "loss_percent", "risk_level", "tips")


@query("scenario_custom", f"""WITH {LATEST}, {VALUED}, h AS (SELECT symbol, asset_type AS kind, value, CASE WHEN symbol = 'Brand#11' THEN -40.0 WHEN asset_type = 'stock' THEN -10.0 WHEN asset_type = 'etf' THEN 5.0 ELSE 0.0 END AS shock FROM valued),
    i AS (SELECT *, value * shock::DOUBLE / 100 AS impact FROM h) SELECT symbol, kind, round(value, 2) AS value, shock::DOUBLE AS shock, round(greatest(value + impact, 0), 4) AS stressed, round(impact, 4) AS impact, round(CASE WHEN impact <> 0 AND sum(impact) OVER () < 0 THEN impact * 100 / sum(impact) OVER () ELSE 0 END, 4) + 0 AS contribution FROM i""", *BOOK)
def scenario_custom(spark, sf):
    """Shocks of one's own by class, and by symbol before that."""
    out = portfolio.impacts(valued(spark, sf), {"CUSTOM": {"stock": -10.0, "etf": 5.0}}, {"brand#11": -40.0})
    return out.select("symbol", "kind", F.round("value", 2).alias("value"), "shock", F.round("stressed", 4).alias("stressed"), (F.round("impact", 4) + 0.0).alias("impact"), (F.round("contribution", 4) + 0.0).alias("contribution"))


@query("scenario_classes", f"WITH {LATEST}, {VALUED}, {SHOCKS} SELECT scenario, kind, round(sum(value), 2) AS value, round(sum(stressed), 4) AS stressed, round((sum(stressed) - sum(value)) * 100 / nullif(sum(value), 0), 2) AS shock FROM hit GROUP BY scenario, kind", *BOOK)
def scenario_classes(spark, sf):
    out = portfolio.class_impacts(portfolio.impacts(valued(spark, sf)))
    return out.select("scenario", "kind", F.round("value", 2).alias("value"), F.round("stressed", 4).alias("stressed"), F.round("shock", 2).alias("shock"))


DELTA = f"{LATEST}, {VALUED}, a AS (SELECT symbol, close, 1 / (count(*) OVER ())::DOUBLE AS w FROM latest), d AS (SELECT symbol, coalesce(w * 1e6, 0) - coalesce(value, 0) AS delta, coalesce(close, price) AS price FROM valued FULL JOIN a USING (symbol))"


def _rebalanced(spark, sf):
    latest = portfolio.latest(views.prices(spark, sf))
    target = latest.withColumn("equal", 1 / latest.agg(F.count(F.lit(1))).scalar())
    return portfolio.rebalance(valued(spark, sf), target, "equal", 1e6)


@query("rebalance_trades", f"WITH {DELTA} SELECT symbol, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(delta, 2) AS delta FROM d WHERE abs(delta) > 1", *BOOK)
def rebalance_trades(spark, sf):
    return _rebalanced(spark, sf).where("side != 'HOLD'").select("symbol", "side", F.round("delta", 2).alias("delta"))


@query("rebalance_plan", f"WITH {DELTA} SELECT symbol, CASE WHEN delta > 1 THEN 'BUY' WHEN delta < -1 THEN 'SELL' ELSE 'HOLD' END AS side, round(delta, 2) AS delta, round(abs(delta) / nullif(price, 0), 3) AS quantity FROM d", *BOOK)
def rebalance_plan(spark, sf):
    return _rebalanced(spark, sf).select("symbol", "side", F.round("delta", 2).alias("delta"), F.round("quantity", 3).alias("quantity"))


FIFO = """f0 AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER (PARTITION BY symbol ORDER BY seq) AS s FROM trades),
    f1 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY symbol ORDER BY seq)) AS held FROM f0),
    f2 AS (SELECT *, CASE WHEN side = 'BUY' THEN quantity ELSE coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY seq), 0) - held END AS q FROM f1),
    f3 AS (SELECT *, sum(q) OVER (PARTITION BY symbol, side ORDER BY seq) AS e, CASE WHEN side = 'BUY' THEN price + fees / quantity ELSE price + (-fees) / quantity END AS unit FROM f2),
    pieces AS (SELECT b.symbol, s.seq AS sell, s.order_date AS sell_date, b.seq AS buy, b.order_date AS buy_date, least(b.e, s.e) - greatest(b.e - b.q, s.e - s.q) AS quantity, b.unit AS cu, s.unit AS pu
    FROM f3 b JOIN f3 s ON b.symbol = s.symbol AND b.side = 'BUY' AND s.side = 'SELL' AND b.e > s.e - s.q AND s.e > b.e - b.q),
    money_pieces AS (SELECT *, floor(quantity * cu * 1000000 + .5::DOUBLE)::BIGINT AS cost, floor(quantity * pu * 1000000 + .5::DOUBLE)::BIGINT AS proceeds FROM pieces)"""


def _cents(x: str) -> str:
    return f"floor(({x})::DOUBLE / 10000 + .5::DOUBLE) / 100"


def pieces(spark, sf):
    return portfolio.fifo(views.orders(spark, sf))


def events(spark, sf):
    return portfolio.tax_events(pieces(spark, sf), views.assets(spark, sf))


@query("fifo_realized", f"WITH {FIFO} SELECT symbol, year(sell_date)::INT AS year, sum(quantity) AS quantity, {_cents('sum(cost)')} AS cost, {_cents('sum(proceeds)')} AS proceeds FROM money_pieces GROUP BY ALL", "trades")
def fifo_realized(spark, sf):
    out = pieces(spark, sf).groupBy("symbol", "year").agg((F.sum("parts") / portfolio.PARTS).alias("quantity"), F.sum("cost").alias("c"), F.sum("proceeds").alias("p"))
    return out.select("symbol", "year", "quantity", portfolio.cents_of(F.col("c")).alias("cost"), portfolio.cents_of(F.col("p")).alias("proceeds"))


EVENTS = f"""{FIFO}, events AS (SELECT symbol, sell, any_value(sell_date) AS sell_date, year(any_value(sell_date))::INT AS year, sum(quantity) AS quantity, {_cents('sum(cost)')} AS cost, {_cents('sum(proceeds)')} AS proceeds, {_cents('sum(proceeds) - sum(cost)')} AS gain,
    greatest(any_value(sell_date) - arg_max(buy_date, buy), 0)::INT AS holding_days FROM money_pieces GROUP BY symbol, sell),
    taxed AS (SELECT events.*, CASE WHEN asset_type IN ('bond', 'bond_etf') THEN 'bond' ELSE 'standard' END AS category, CASE WHEN asset_type IN ('bond', 'bond_etf') THEN 12.5 ELSE 26 END::DOUBLE AS rate FROM events JOIN assets USING (symbol))"""


@query("tax_events", f"WITH {EVENTS} SELECT symbol, sell_date, year, category, quantity, cost, proceeds, gain, rate, holding_days FROM taxed", "trades", "assets")
def tax_events(spark, sf):
    return events(spark, sf).select("symbol", "sell_date", "year", "category", "quantity", "cost", "proceeds", "gain", "rate", "holding_days")


@query("realized_measures", f"""WITH {EVENTS}, m AS (SELECT symbol, count(*) AS sells, count_if(gain > 0) * 100 / count(*) AS win_rate, coalesce(sum(gain) FILTER (WHERE gain > 0), 0) AS won, coalesce(-sum(gain) FILTER (WHERE gain < 0), 0) AS lost FROM events GROUP BY symbol)
    SELECT symbol, sells, round(win_rate, 4) AS win_rate, round(won, 2) AS won, round(lost, 2) AS lost, round(CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 999 ELSE 0 END, 4)::DOUBLE AS profit_factor FROM m""", "trades", "assets")
def realized_measures(spark, sf):
    """Win rate and profit factor of each symbol's matched sells."""
    sold = events(spark, sf).select(F.col("symbol").alias("run_id"), F.lit("SELL").alias("side"), F.col("gain").alias("pnl"))
    out = backtest.trade_measures(sold)
    return out.select(F.col("run_id").alias("symbol"), "sells", F.round("win_rate", 4).alias("win_rate"), F.round("won", 2).alias("won"), F.round("lost", 2).alias("lost"), F.round("profit_factor", 4).alias("profit_factor"))


@query("paper_cash", """WITH n AS (SELECT *, round(price * quantity + CASE WHEN side = 'BUY' THEN fees ELSE -fees END, 2) AS net FROM trades),
    c AS (SELECT *, 1e6 - sum(CASE WHEN side = 'BUY' THEN net ELSE -net END) OVER (PARTITION BY symbol ORDER BY seq) AS cash FROM n)
    SELECT symbol AS account, order_date, side, net, round(cash, 2)::DOUBLE AS cash, round(cash, 2) < 0 AS short FROM c""", "trades")
def paper_cash(spark, sf):
    """Running cash of a paper account for each symbol, and where it would have run short."""
    out = portfolio.paper_account(views.orders(spark, sf).withColumn("account", F.col("symbol")), 1e6)
    return out.select("account", "order_date", "side", F.round("net", 2).alias("net"), F.round("cash", 2).alias("cash"), (F.round("cash", 2) < 0).alias("short"))


# Years one after another, as a person would fill in the form.
TAX = f"""{EVENTS}, y AS (SELECT category, year, coalesce(sum(floor(gain * 100 + .5::DOUBLE)) FILTER (WHERE gain > 0), 0)::BIGINT AS g, coalesce(sum(floor(-gain * 100 + .5::DOUBLE)) FILTER (WHERE gain < 0), 0)::BIGINT AS l FROM taxed GROUP BY category, year),
    grid AS (SELECT c.category, d.year, coalesce(y.g, 0) AS g, coalesce(y.l, 0) AS l, row_number() OVER (PARTITION BY c.category ORDER BY d.year) AS k FROM (SELECT DISTINCT year FROM y) d CROSS JOIN (SELECT unnest(['bond', 'standard']) AS category) c LEFT JOIN y ON y.year = d.year AND y.category = c.category),
    form AS (SELECT category, year, g, l, k, l AS there, greatest(l - g, 0) AS carry FROM grid WHERE k = 1 UNION ALL SELECT n.category, n.year, n.g, n.l, n.k, n.l + f.carry, greatest(n.l + f.carry - n.g, 0) FROM form f JOIN grid n ON n.category = f.category AND n.k = f.k + 1),
    taxes AS (SELECT category, year::INT AS year, g / 100 AS gains, l / 100 AS losses, least(g, there) / 100 AS used, carry / 100 AS carry, greatest(g - there, 0) * CASE category WHEN 'bond' THEN 12.5 ELSE 26 END::DOUBLE / 10000 AS tax FROM form)"""


@query("tax_by_year", f"WITH RECURSIVE {TAX} SELECT category, year, gains, losses, used, carry, round(tax, 4) AS tax FROM taxes", "trades", "assets")
def tax_by_year(spark, sf):
    return portfolio.tax(events(spark, sf)).withColumn("tax", F.round("tax", 4))


@query("tax_years", f"WITH RECURSIVE {TAX} SELECT year, round(sum(gains), 2) AS gains, round(sum(losses), 2) AS losses, round(sum(used), 2) AS used, round(sum(carry), 2) AS carry, round(sum(gains) - sum(losses), 2) AS net FROM taxes GROUP BY year", "trades", "assets")
def tax_years(spark, sf):
    return portfolio.tax_years(portfolio.tax(events(spark, sf))).drop("tax")


OPEN = f"""{FIFO}, sold AS (SELECT symbol, sum(q) AS m FROM f3 WHERE side = 'SELL' GROUP BY symbol), left_over AS (SELECT b.symbol, b.e - greatest(b.e - b.q, coalesce(m, 0)) AS quantity, b.unit FROM f3 b LEFT JOIN sold USING (symbol) WHERE b.side = 'BUY' AND b.e > coalesce(m, 0)),
    lots AS (SELECT symbol, sum(quantity) AS quantity, sum(floor(quantity * unit * 1000000 + .5::DOUBLE)::BIGINT) AS cost FROM left_over GROUP BY symbol)"""


@query("open_lots", f"WITH {LATEST}, {OPEN} SELECT symbol, asset_type, quantity, {_cents('cost')} AS cost, {_cents('floor(quantity * close * 1000000 + .5::DOUBLE)')} AS value, {_cents('floor(quantity * close * 1000000 + .5::DOUBLE) - cost')} AS unrealized FROM lots LEFT JOIN latest USING (symbol) LEFT JOIN assets USING (symbol)", "prices", "trades", "assets")
def open_lots(spark, sf):
    return portfolio.open_lots(views.orders(spark, sf), portfolio.latest(views.prices(spark, sf)), views.assets(spark, sf))


# The same in whole billionths, over quantities such as 1.26: sums of doubles would meet nowhere.
PARTS = """g0 AS (SELECT *, floor(quantity * 1e9::DOUBLE + .5::DOUBLE)::BIGINT AS n FROM fractions), g1 AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN n ELSE -n END) OVER (PARTITION BY symbol ORDER BY seq) AS s FROM g0 WHERE n > 0),
    g2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY symbol ORDER BY seq)) AS held FROM g1), g3 AS (SELECT *, CASE WHEN side = 'BUY' THEN n ELSE coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY seq), 0) - held END AS q FROM g2),
    g4 AS (SELECT *, sum(q) OVER (PARTITION BY symbol, side ORDER BY seq) AS e, CASE WHEN side = 'BUY' THEN price + fees / quantity ELSE price + (-fees) / quantity END AS unit FROM g3 WHERE q > 0),
    cuts AS (SELECT DISTINCT symbol, e FROM g4), spans AS (SELECT symbol, e, e - coalesce(lag(e) OVER (PARTITION BY symbol ORDER BY e), 0) AS n FROM cuts),
    pieces AS (SELECT p.symbol, p.n, b.seq AS buy, b.order_date AS buy_date, b.unit AS cu, s.seq AS sell, s.order_date AS sell_date, s.unit AS pu FROM spans p ASOF JOIN (SELECT * FROM g4 WHERE side = 'BUY') b ON p.symbol = b.symbol AND p.e <= b.e ASOF JOIN (SELECT * FROM g4 WHERE side = 'SELL') s ON p.symbol = s.symbol AND p.e <= s.e),
    paid AS (SELECT *, floor(n / 1e9::DOUBLE * cu * 1000000 + .5::DOUBLE)::BIGINT AS cost, floor(n / 1e9::DOUBLE * pu * 1000000 + .5::DOUBLE)::BIGINT AS proceeds FROM pieces)"""


@query("tax_events_fractions", f"WITH {PARTS} SELECT symbol, any_value(sell_date) AS sell_date, (sum(n) / 1e9::DOUBLE)::DOUBLE AS quantity, {_cents('sum(cost)')} AS cost, {_cents('sum(proceeds)')} AS proceeds, {_cents('sum(proceeds) - sum(cost)')} AS gain, greatest(any_value(sell_date) - arg_max(buy_date, buy), 0)::INT AS holding_days FROM paid GROUP BY symbol, sell", "fractions")
def tax_events_fractions(spark, sf):
    """Matched sells of an order log with fractional quantities."""
    out = portfolio.tax_events(portfolio.fifo(views.fractions(spark, sf)), views.assets(spark, sf))
    return out.select("symbol", "sell_date", "quantity", "cost", "proceeds", "gain", "holding_days")


@query("open_lots_fractions", f"""WITH {PARTS}, sold AS (SELECT symbol, sum(q) AS m FROM g4 WHERE side = 'SELL' GROUP BY symbol), rest AS (SELECT g4.symbol, e - greatest(e - q, coalesce(m, 0)) AS n, unit FROM g4 LEFT JOIN sold USING (symbol) WHERE side = 'BUY' AND e > coalesce(m, 0))
    SELECT symbol, (sum(n) / 1e9::DOUBLE)::DOUBLE AS quantity, {_cents('sum(floor(n / 1e9::DOUBLE * unit * 1000000 + .5::DOUBLE)::BIGINT)')} AS cost FROM rest GROUP BY symbol""", "fractions")
def open_lots_fractions(spark, sf):
    """What is left of buys of fractional quantities."""
    return portfolio.open_lots(views.fractions(spark, sf), portfolio.latest(views.prices(spark, sf)), views.assets(spark, sf)).select("symbol", "quantity", "cost")


@query("report_summary", f"WITH {LATEST}, {VALUED}, {FIFO} SELECT (SELECT count(*) FROM valued) AS positions_count, (SELECT count(*) FROM trades) AS orders_count, (SELECT count(DISTINCT (symbol, sell)) FROM pieces) AS realized_events, (SELECT round(sum(value), 2) FROM valued) AS portfolio_value", "trades", *BOOK)
def report_summary(spark, sf):
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    rows = valued(spark, sf).agg(F.count(F.lit(1)).alias("positions_count"), F.round(F.sum("value"), 2).alias("portfolio_value"))
    return rows.select("positions_count", count(views.orders(spark, sf)).alias("orders_count"), count(pieces(spark, sf).select("symbol", "sell").distinct()).alias("realized_events"), "portfolio_value")

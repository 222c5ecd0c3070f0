"""DuckDB SQL of the registered queries, over the same tables; written from the definitions, with plain whole windows."""

from __future__ import annotations

from quaver.functions.dist import chi2_ppf
from quaver.operators.trades import expected_maximum
from quaver.sources.market import SYMBOLS

DAILY = """daily AS (SELECT symbol, epoch, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close FROM (
  SELECT l_returnflag AS symbol, CAST(epoch(l_shipdate) AS BIGINT) AS epoch, l_extendedprice AS p, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) GROUP BY symbol, epoch)"""
TICKS = "ticks AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, value AS quote, CAST(event_id AS VARCHAR) AS tick_id, event_id * 7919 % 10007 * 10000000 + event_id AS arrival FROM events)"
HOURLY = """hourly AS (SELECT symbol, second - second % 3600 AS epoch, arg_min(value, row(second, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(second, event_id)) AS close FROM (
  SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS second, event_id, value FROM events) GROUP BY 1, 2)"""
NAMED = "symbols AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', CAST({v} AS DOUBLE), {t})" for s, v, t in SYMBOLS) + ") t(symbol, stated_vol, tick_interval))"


def segments(table: str, step: int) -> str:
    return f"""seg AS (SELECT *, max(start) OVER (PARTITION BY symbol ORDER BY epoch) AS segment FROM (
  SELECT *, CASE WHEN coalesce(epoch - lag(epoch) OVER (PARTITION BY symbol ORDER BY epoch), -1) <> {step} THEN epoch END AS start FROM {table})),
ret AS (SELECT *, CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END AS r FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, segment ORDER BY epoch) AS pc FROM seg))"""


BASE = f"WITH RECURSIVE {DAILY}, {segments('daily', 86400)}"
YEAR = "(31536000.0 / 86400)"


def w(n: int) -> str:
    return f"OVER (PARTITION BY symbol, segment ORDER BY epoch ROWS {n - 1} PRECEDING)"


O = "OVER (PARTITION BY symbol, segment ORDER BY epoch)"  # noqa: E741


def full(value: str, n: int, column: str = "r") -> str:
    return f"CASE WHEN count({column}) {w(n)} = {n} THEN {value} END"


def unsigned(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def rolling(name: str, value: str, n: int, column: str = "r", source: str = "ret") -> str:
    return f"{BASE} SELECT symbol, epoch, {unsigned(full(value, n, column))} AS {name} FROM {source}"


Z = full(f"(close - avg(close) {w(20)}) / nullif(stddev_pop(close) {w(20)}, 0)", 20, "close")
ELAPSED = full(f"sqrt(sum(r * r) {w(20)} * 31536000 / (20 * 86400))", 20)


def sums(h: int) -> str:
    return f"(SELECT *, CASE WHEN count(r) {w(h)} = {h} THEN sum(r) {w(h)} END AS s FROM ret)"


def vr(n: int, h: int = 2) -> str:
    m = n - h + 1
    many = f"(sum(s * s) {w(m)} - 2 * {h} * avg(r) {w(n)} * sum(s) {w(m)} + {m} * {h * h} * (avg(r) {w(n)}) * (avg(r) {w(n)})) / ({h} * {m} * (1 - {h} / {n}.0))"
    return full(f"{many} / nullif(var_samp(r) {w(n)}, 0)", n)


def pearson(n: int) -> str:
    x = {k: f"sum({k}) {w(n)}" for k in ("r", "y", "r * r", "y * y", "r * y")}
    vx, vy = f"({n} * {x['r * r']} - {x['r']} * {x['r']})", f"({n} * {x['y * y']} - {x['y']} * {x['y']})"
    return f"CASE WHEN count(r) {w(n)} = {n} AND count(y) {w(n)} = {n} AND {vx} > 1e-18 AND {vy} > 1e-18 THEN ({n} * {x['r * y']} - {x['r']} * {x['y']}) / sqrt({vx} * {vy}) END"


#: Rescaled range of every window of 64 returns: chunks of 8, 16 and 32, means of their ranges, slope over log size.
RS = f"""win AS (SELECT symbol, epoch, list(r) {w(64)} AS xs FROM ret QUALIFY count(r) {w(64)} = 64),
parts AS (SELECT symbol, epoch, size, c, list_slice(xs, c * size + 1, c * size + size) AS x FROM win, (VALUES (8), (16), (32)) t(size), range(0, 8) u(c) WHERE c < 64 // size),
items AS (SELECT symbol, epoch, size, c, unnest(x) AS v, generate_subscripts(x, 1) AS i, list_avg(x) AS m FROM parts),
walks AS (SELECT symbol, epoch, size, c, v, m, sum(v - m) OVER (PARTITION BY symbol, epoch, size, c ORDER BY i) AS s FROM items),
ranges AS (SELECT symbol, epoch, size, (max(s) - min(s)) / nullif(sqrt(sum((v - m) * (v - m)) / (size - 1)), 0) AS rs FROM walks GROUP BY symbol, epoch, size, c),
levels AS (SELECT symbol, epoch, ln(size) AS x, ln(avg(rs)) AS y FROM ranges GROUP BY symbol, epoch, size),
hurst AS (SELECT symbol, epoch, regr_slope(y, x) AS hurst FROM levels GROUP BY symbol, epoch HAVING count(y) = 3)"""


def recursion(a: str, **bs: str) -> str:
    names = ", ".join(bs)
    return f"""ix AS (SELECT *, (epoch - segment) // 86400 AS i, row_number() OVER (PARTITION BY symbol ORDER BY epoch) AS n FROM ret),
ab AS (SELECT *, CAST({a} AS DOUBLE) AS a, {', '.join(f'CAST({b} AS DOUBLE) AS b_{k}' for k, b in bs.items())} FROM ix),
run AS (SELECT symbol, epoch, n, i, {', '.join(f'b_{k} AS {k}' for k in bs)} FROM ab WHERE n = 1
  UNION ALL SELECT ab.symbol, ab.epoch, ab.n, ab.i, {', '.join(f'ab.a * run.{k} + ab.b_{k}' for k in bs)} FROM run JOIN ab ON ab.symbol = run.symbol AND ab.n = run.n + 1)"""


def ema(n: int) -> str:
    k = f"(2.0 / {n + 1})"
    return recursion(f"CASE WHEN i = 0 THEN 0 ELSE 1 - {k} END", y=f"CASE WHEN i = 0 THEN close ELSE close * {k} END")


RSI = recursion("CASE WHEN i = 0 THEN 0 WHEN i <= 14 THEN 1 ELSE 1 - 1.0 / 14 END", gain="greatest(coalesce(close - pc, 0), 0) / 14.0", loss="greatest(coalesce(pc - close, 0), 0) / 14.0")
RSI_VALUE = "CASE WHEN i >= 14 THEN CASE WHEN gain = 0 AND loss = 0 THEN 50 ELSE 100 * gain / (gain + loss) END END"
ATR = recursion("CASE WHEN i = 0 THEN 0 WHEN i < 14 THEN 1 ELSE 1 - 1.0 / 14 END", y="greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) / 14.0")


def renamed(part: str, to: str) -> str:
    return part.replace("ix AS", f"ix{to} AS").replace("FROM ix)", f"FROM ix{to})").replace("ab AS", f"ab{to} AS").replace("FROM ab ", f"FROM ab{to} ").replace("JOIN ab ON", f"JOIN ab{to} AS ab ON").replace("run AS (", f"run{to} AS (").replace("FROM run ", f"FROM run{to} AS run ")


def lagged(source: str) -> str:
    return f"(SELECT *, lag(r) {O} AS y FROM {source})"


def feature_tables(source: str) -> str:
    """Segments, returns, features and flags of a table of candles; a symbol may carry a part behind a bar."""
    return f"""{segments(source, 86400)}, {NAMED}, {RS}, {renamed(RSI, '1')}, {renamed(ema(20), '2')}, {renamed(ema(50), '3')},
windows AS (SELECT symbol, epoch, close, {Z} AS z, {ELAPSED} AS vol, {pearson(49)} AS autocorr, {vr(64)} AS vr FROM {lagged(sums(2))}),
features AS (SELECT f.symbol, f.epoch, f.close, {RSI_VALUE.replace(' i >', ' run1.i >')} AS rsi, z, CASE WHEN run2.i >= 19 THEN run2.y END AS ema20, CASE WHEN run3.i >= 49 THEN run3.y END AS ema50, vol, autocorr, hurst, vr, stated_vol, vol / stated_vol AS vol_ratio
  FROM windows f JOIN run1 USING (symbol, epoch) JOIN run2 USING (symbol, epoch) JOIN run3 USING (symbol, epoch) LEFT JOIN hurst USING (symbol, epoch) JOIN symbols k ON k.symbol = split_part(f.symbol, '|', 1)),
flags AS (SELECT symbol, epoch, rsi >= 70 AS overbought, abs(z) >= 2 AS stretched, (vol_ratio > 1.5) OR (vol_ratio < 0.5) AS vol_mismatch,
  CASE WHEN hurst IS NOT NULL AND vr IS NOT NULL THEN hurst > 0.55 AND vr > 1 END AS trending_regime, CASE WHEN hurst IS NOT NULL AND vr IS NOT NULL THEN hurst < 0.45 AND vr < 1 END AS mean_reverting_regime FROM features)"""


FEATURES = f"WITH RECURSIVE {DAILY}, {feature_tables('daily')}"
MEASURES = ("close", "rsi", "z", "ema20", "ema50", "vol", "autocorr", "hurst", "vr", "stated_vol", "vol_ratio")
FEATURE_COLUMNS = "symbol, epoch, " + ", ".join(f"{unsigned(c)} AS {c}" for c in MEASURES)
FLAGS = ("overbought", "stretched", "vol_mismatch", "trending_regime", "mean_reverting_regime")
#: The last 2000 candles of a symbol, their parts, and the last contiguous run of each part as a series of its own.
PARTS = f"""{DAILY}, latest AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY epoch) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY epoch DESC) <= 2000)),
splits AS (SELECT *, CASE WHEN k < floor(n * 0.6::DOUBLE) THEN 'calibration' WHEN k < floor(n * 0.7::DOUBLE) THEN 'holdout' ELSE 'display' END AS part FROM latest),
islands AS (SELECT *, sum(CASE WHEN epoch - pe = 86400 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, part ORDER BY epoch) AS island FROM (SELECT *, lag(epoch) OVER (PARTITION BY symbol, part ORDER BY epoch) AS pe FROM splits)),
runs_of_parts AS (SELECT symbol || '|' || part AS symbol, epoch, open, high, low, close FROM (SELECT *, max(island) OVER (PARTITION BY symbol, part) AS top FROM islands) WHERE part <> 'holdout' AND island = top)"""
SCREEN = f"WITH RECURSIVE {PARTS}, {feature_tables('runs_of_parts')}"
NAME = "split_part(symbol, '|', 1)"


def trades(h: int, fixed: bool = False, signal: str = "CAST(sign(close - open) AS DOUBLE)", stake: float = 10.0, multiplier: float = 5.0, stop: float = 0.5, commission: float = 0.1, spread: float = 0.002, payout: float = 0.8) -> str:
    if fixed:
        notional, gross, why, leave, gross_won = stake, f"CAST(CASE WHEN move > 0 THEN {stake * payout} ELSE -{stake} END AS DOUBLE)", "'bar_close'", "close", "move > 0"
    else:
        notional = stake * multiplier
        out = f"{notional} * worst <= -{stake} * {stop}"
        gross, why, leave = f"CASE WHEN {out} THEN -{stake} * {stop} ELSE {notional} * move END", f"CASE WHEN {out} THEN 'stop_out' ELSE 'bar_close' END", f"CASE WHEN {out} THEN entry * (1 - direction * {stop} / {multiplier}) ELSE close END"
        gross_won = f"{gross} > 0"
    return f"""pos AS (SELECT *, lag(epoch, {h}) {O} AS decision, lag(signal, {h}) {O} AS direction, lag(open, {h - 1}) {O} AS entry, min(low) {w(h)} AS lo, max(high) {w(h)} AS hi FROM (SELECT *, {signal} AS signal FROM seg)),
moved AS (SELECT *, direction * (close - entry) / entry AS move, direction * (CASE WHEN direction > 0 THEN lo ELSE hi END - entry) / entry AS worst FROM pos WHERE direction <> 0 AND entry > 0),
trades AS (SELECT symbol, decision AS at, decision + 86400 AS decision, decision + 86400 AS entry_epoch, epoch + 86400 AS exit_epoch, direction, entry, {leave} AS exit, CAST({gross} AS DOUBLE) AS gross, CAST({commission} AS DOUBLE) AS commission,
  CAST({notional} AS DOUBLE) * {spread} AS spread_cost, CAST({gross} - {commission} - {notional} * {spread} AS DOUBLE) AS net, {why} AS reason, {gross_won} AS gross_won FROM moved)"""


TRADE_COLUMNS = "symbol, decision, entry_epoch, exit_epoch, direction, entry, round(exit, 6) AS exit, round(gross, 6) + 0.0 AS gross, commission, spread_cost, round(net, 6) + 0.0 AS net, reason, net > 0 AS won, gross_won"


def tail(k: str, n: str, p: str) -> str:
    """P(X >= k) of a binomial."""
    return f"least(1.0, list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})))))"


def phi(z: str) -> str:
    """The normal distribution function by its series over odd double factorials."""
    return f"CASE WHEN abs({z}) > 8 THEN CAST({z} > 0 AS DOUBLE) ELSE (0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-12)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))) END"


def chi2_sf(x: str, df: str) -> str:
    """The upper tail of chi-square by the series of the lower one."""
    return f"(1 - list_sum(list_transform(range(0, 600), lambda k: exp((({df}) / 2.0 + k) * ln(greatest(({x}) / 2.0, 1e-300)) - ({x}) / 2.0 - lgamma(({df}) / 2.0 + k + 1)))))"


def adjusted(source: str, p: str = "p", q: str = "q") -> str:
    """source with q, its p adjusted over all rows."""
    return f"(SELECT * EXCLUDE (rk, m), least(1.0, min({p} * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {q} FROM (SELECT *, row_number() OVER (ORDER BY {p}) AS rk, count(*) OVER () AS m FROM {source}))"


def report(keys: str, product_stake: float = 10.0, extra: str = "", need: str = "NULL", trials_z: float = 0.0) -> str:
    """Totals of each (candles with the keys; trades) that `evaluated` joins."""
    k = f"{keys}, " if keys else ""
    return f"""moments AS (SELECT {k}avg(net / {product_stake}) AS mu, var_pop(net / {product_stake}) AS m2, stddev_samp(net / {product_stake}) AS sd, count(net) AS n FROM evaluated GROUP BY {keys}),
shapes AS (SELECT {k}any_value(mu) AS mu, any_value(sd) AS sd, any_value(n) AS n, avg(pow(net / {product_stake} - mu, 3)) / pow(any_value(m2), 1.5) AS skew, avg(pow(net / {product_stake} - mu, 4)) / pow(any_value(m2), 2) AS kurt FROM evaluated JOIN moments USING ({keys}) WHERE net IS NOT NULL GROUP BY {keys}),
zs AS (SELECT {k}(mu / sd - {trials_z!r}) * sqrt(n - 1) / sqrt(1 - skew * mu / sd + (kurt - 1) * mu * mu / sd / sd / 4) AS z FROM shapes WHERE n > 1 AND sd > 0),
report AS (SELECT {k}count(net) AS observations, count(*) AS period_observations, CAST(coalesce(sum(missing), 0) AS BIGINT) AS gap_count, coalesce(sum(net), 0) AS net, coalesce(avg(net), 0) AS expectancy, coalesce(stddev_samp(net), 0) AS sd_net, coalesce(count(CASE WHEN net > 0 THEN 1 END) / nullif(count(net), 0), 0) AS win_rate,
  coalesce(avg(coalesce(net, 0) / {product_stake}) / nullif(stddev_samp(coalesce(net, 0) / {product_stake}), 0) * sqrt({YEAR}), 0) AS sharpe, CAST({need} AS DOUBLE) AS break_even_win_rate FROM evaluated GROUP BY {keys})"""


def gaps_of(keys: str) -> str:
    return f"CASE WHEN lag(epoch) OVER (PARTITION BY {keys} ORDER BY epoch) IS NOT NULL THEN greatest(0, ceil((epoch - lag(epoch) OVER (PARTITION BY {keys} ORDER BY epoch)) / 86400) - 1) END AS missing"


REPORT_COLUMNS = "observations, period_observations, gap_count, round(net, 6) + 0.0 AS net, round(expectancy, 6) + 0.0 AS expectancy, round(sd_net, 6) + 0.0 AS sd_net, round(win_rate, 6) + 0.0 AS win_rate, round(sharpe, 6) + 0.0 AS sharpe, round(break_even_win_rate, 6) + 0.0 AS break_even_win_rate, round(z, 6) + 0.0 AS deflated_z"
EVALUATED = f"evaluated AS (SELECT d.symbol, net, missing FROM (SELECT *, {gaps_of('symbol')} FROM daily) d LEFT JOIN trades t ON d.symbol = t.symbol AND d.epoch = t.entry_epoch)"


COVERAGE = f"""{TICKS}, {NAMED}, t AS (SELECT * FROM ticks JOIN symbols USING (symbol)),
ends AS (SELECT symbol, tick_interval AS k, min(epoch) AS low, max(epoch) AS high FROM t GROUP BY ALL),
days AS (SELECT symbol, k, unnest(range(low // 86400, high // 86400 + 1)) AS day, low, high FROM ends),
want AS (SELECT symbol, day, CAST(greatest(0, floor(least(high, day * 86400 + 86399) / k) - ceil(greatest(low, day * 86400) / k) + 1) AS BIGINT) AS expected FROM days),
seen AS (SELECT symbol, epoch // 86400 AS day, count(DISTINCT epoch) AS observed FROM t WHERE epoch % tick_interval = 0 GROUP BY ALL),
coverage AS (SELECT symbol, day, expected, coalesce(observed, 0) AS observed, CASE WHEN expected = 0 THEN 100.0 ELSE 100.0 * coalesce(observed, 0) / expected END AS coverage FROM want LEFT JOIN seen USING (symbol, day))"""
CALLS = """calls AS (SELECT symbol, epoch, strategy, direction FROM (
  SELECT symbol, epoch, 'trend' AS strategy, CASE WHEN ema20 > ema50 THEN 1 WHEN ema20 < ema50 THEN -1 END AS direction FROM features
  UNION ALL SELECT symbol, epoch, 'reversion', CASE WHEN z <= -1 THEN 1 WHEN z >= 1 THEN -1 END FROM features
  UNION ALL SELECT symbol, epoch, 'rsi', CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 END FROM features
  UNION ALL SELECT symbol, epoch, 'coin', CASE WHEN ('0x' || substr(sha256(symbol || ':' || epoch), 1, 2))::INTEGER % 2 = 0 THEN 1 ELSE -1 END FROM features) WHERE direction IS NOT NULL)"""

TREND = "CASE WHEN ema20 IS NULL OR ema50 IS NULL THEN 'insufficient_data' WHEN ema20 > ema50 THEN 'ema20_above_ema50' WHEN ema20 < ema50 THEN 'ema20_below_ema50' ELSE 'ema20_equal_ema50' END"
#: Long trades of one candle after each flag in the last run of calibration; what its last row flags can't be traded.
MARKS = f"""{SCREEN}, {trades(1, signal='1.0::DOUBLE', stake=1.0, multiplier=1.0, stop=1.0, commission=0.0, spread=0.0)}, marks AS (SELECT f.symbol, f.epoch, t.net AS ret, {', '.join(f'coalesce({f}, false) AND t.net IS NOT NULL AS {f}' for f in FLAGS)}
  FROM flags f LEFT JOIN trades t ON t.symbol = f.symbol AND t.at = f.epoch WHERE f.symbol LIKE '%|calibration'),
each AS (SELECT split_part(symbol, '|', 1) AS symbol, epoch, ret, flag, yes AS on_ FROM (UNPIVOT marks ON {', '.join(FLAGS)} INTO NAME flag VALUE yes)),
reliable AS (SELECT symbol, flag, count(CASE WHEN on_ THEN 1 END) AS observations, avg(CASE WHEN on_ THEN ret END) AS edge, avg(CASE WHEN on_ THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END) AS hit_rate FROM each GROUP BY ALL)"""
TURNS = f"""{MARKS}, placed AS (SELECT *, row_number() OVER (PARTITION BY symbol, flag ORDER BY epoch) - 1 AS i, count(*) OVER (PARTITION BY symbol, flag) AS n FROM each),
lit AS (SELECT p.symbol, p.flag, p.i, p.n FROM placed p JOIN reliable r USING (symbol, flag) WHERE on_ AND observations >= 5),
turned AS (SELECT l.symbol, l.flag, l.k, avg(p.ret) AS m FROM (SELECT symbol, flag, n, i, unnest(range(1, n)) AS k FROM lit) l JOIN placed p ON p.symbol = l.symbol AND p.flag = l.flag AND p.i = (l.i + l.k) % l.n GROUP BY ALL),
shifts AS (SELECT r.symbol, r.flag, CASE WHEN r.observations >= 5 THEN (1 + count(CASE WHEN abs(coalesce(m, 0)) >= abs(edge) - 1e-12 THEN 1 END)) / (count(k) + 1) END AS p FROM reliable r LEFT JOIN turned USING (symbol, flag) GROUP BY r.symbol, r.flag, r.observations, edge)"""


def monitor(n: int) -> str:
    """Windows over the returns of exactly one step, and a row for symbols with too few."""
    low, high = chi2_ppf(0.005, n - 1), chi2_ppf(0.995, n - 1)
    return f"""{NAMED}, kept AS (SELECT symbol, epoch, ln(close / pc) AS r FROM (SELECT *, lag(close) OVER q AS pc, lag(epoch) OVER q AS pe FROM daily WINDOW q AS (PARTITION BY symbol ORDER BY epoch)) WHERE epoch - pe = 86400),
windowed AS (SELECT symbol, epoch, var_samp(r) OVER q * {YEAR} AS v FROM kept WINDOW q AS (PARTITION BY symbol ORDER BY epoch ROWS {n - 1} PRECEDING) QUALIFY count(*) OVER q = {n}),
few AS (SELECT d.symbol, coalesce(max(k.epoch), max(d.epoch)) AS epoch, count(k.epoch) AS observations FROM daily d LEFT JOIN kept k USING (symbol, epoch) GROUP BY d.symbol HAVING count(k.epoch) < {n}),
monitor AS (SELECT symbol, epoch, CAST({n} AS BIGINT) AS observations, stated_vol, 'ok' AS status, sqrt(v) AS realized, sqrt(v * {n - 1} / {high!r}) AS low, sqrt(v * {n - 1} / {low!r}) AS high, stated_vol < sqrt(v * {n - 1} / {high!r}) OR stated_vol > sqrt(v * {n - 1} / {low!r}) AS alert FROM windowed JOIN symbols USING (symbol)
  UNION ALL SELECT symbol, epoch, observations, stated_vol, 'insufficient_data', NULL, NULL, NULL, NULL FROM few JOIN symbols USING (symbol))"""


MONITOR_COLUMNS = f"symbol, epoch, observations, {unsigned('stated_vol')} AS stated_vol, status, {unsigned('realized')} AS realized, {unsigned('low')} AS low, {unsigned('high')} AS high, alert"


def signal_eval(h: int) -> str:
    return f"""WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY epoch) - 1 AS place, lead(close, {h}) OVER (PARTITION BY symbol ORDER BY epoch) / close - 1 AS ret, sign(close - open) AS side FROM daily),
o AS (SELECT *, side * ret AS out, place % {h} = 0 AS apart FROM n WHERE ret IS NOT NULL AND side <> 0),
a AS (SELECT symbol, count(*) AS observations, count(CASE WHEN out = 0 THEN 1 END) AS tie_count, count(CASE WHEN apart AND out <> 0 THEN 1 END) AS n_effective, avg(ret) AS mean, median(ret) AS median, coalesce(stddev_samp(ret), 0) AS sd, count(CASE WHEN apart AND out > 0 THEN 1 END) AS hits, avg(CASE WHEN apart THEN out END) AS mean_signed FROM o GROUP BY symbol),
v AS (SELECT symbol, ret, side, row_number() OVER (PARTITION BY symbol ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS m FROM n WHERE ret IS NOT NULL AND place % {h} = 0),
k AS (SELECT x.symbol, (y.i - x.i + x.m) % x.m AS k, any_value(x.m) AS m, sum(x.side * y.ret) AS s FROM v x JOIN v y ON x.symbol = y.symbol AND x.side <> 0 GROUP BY 1, 2),
pp AS (SELECT symbol, count(CASE WHEN abs(s) >= abs(own) - 1e-12 THEN 1 END) / any_value(m) AS permutation_p FROM k JOIN (SELECT symbol, s AS own FROM k WHERE k = 0) USING (symbol) GROUP BY symbol)
SELECT symbol, round(permutation_p, 6) + 0.0 AS permutation_p, observations, tie_count, n_effective, {unsigned('mean')} AS mean, {unsigned('median')} AS median, {unsigned('sd')} AS sd, {unsigned('coalesce(hits / nullif(n_effective, 0), 0)')} AS hit_rate, {unsigned('mean_signed')} AS mean_signed, hits,
CASE WHEN n_effective > 0 THEN round(least(1.0, 2 * {tail('greatest(hits, n_effective - hits)', 'n_effective', '0.5::DOUBLE')}), 6) + 0.0 ELSE 1.0 END AS binomial_p, {str(h == 1).lower()} AS binomial_is_inferential FROM a LEFT JOIN pp USING (symbol)"""


SCORES = """scores AS (SELECT c.*, e.open AS entry, x.close AS exit, CASE WHEN c.epoch + 6 * 86400 > 852076800 THEN 'pending' WHEN e.open IS NULL OR x.close IS NULL THEN 'void' WHEN direction * (x.close - e.open) > 0 THEN 'win' ELSE 'loss' END AS outcome
  FROM calls c LEFT JOIN daily e ON e.symbol = c.symbol AND e.epoch = c.epoch + 86400 LEFT JOIN daily x ON x.symbol = c.symbol AND x.epoch = c.epoch + 5 * 86400)"""
SCORE_COLUMNS = "symbol, epoch, strategy, direction, round(entry, 6) + 0.0 AS entry, round(exit, 6) + 0.0 AS exit, outcome"

#: Trades of an hour.
HOURS = f"WITH RECURSIVE {HOURLY}, {segments('hourly', 3600)}, {trades(1).replace('86400', '3600')}"

ORACLES: dict[str, str] = {
    "scan_ticks_range": f"WITH {TICKS} SELECT symbol, epoch, round(quote, 6) + 0.0 AS quote, tick_id FROM ticks WHERE epoch BETWEEN 1704672000 AND 1705276800",
    "scan_ticks_bounds": f"WITH {TICKS} SELECT symbol, epoch, round(quote, 6) + 0.0 AS quote, tick_id FROM ticks WHERE symbol = 'click' AND epoch BETWEEN 1704672000 AND 1705276800",
    "scan_candles_range": f"WITH {DAILY} SELECT * FROM daily WHERE symbol = 'A' AND epoch BETWEEN 820454400 AND 852076800",
    "upsert_latest_wins": f"""WITH {TICKS}, two AS (SELECT symbol, epoch, quote, CAST(tick_id AS BIGINT) AS id, 0 AS new FROM ticks UNION ALL SELECT symbol, epoch + 1800, quote * 2, CAST(tick_id AS BIGINT), 1 FROM ticks)
SELECT symbol, epoch, round(quote, 6) + 0.0 AS quote, id AS tick_id FROM two QUALIFY row_number() OVER (PARTITION BY symbol, epoch ORDER BY new DESC, id DESC) = 1""",
    "upsert_all_ticks": f"""WITH {TICKS}, two AS (SELECT symbol, epoch, quote, CAST(tick_id AS BIGINT) AS id, 0 AS new FROM ticks UNION ALL SELECT symbol, epoch, quote + 1, CAST(tick_id AS BIGINT), 1 FROM ticks)
SELECT symbol, epoch, round(quote, 6) + 0.0 AS quote, id AS tick_id FROM two QUALIFY row_number() OVER (PARTITION BY symbol, epoch ORDER BY new DESC, id DESC) = 1""",
    "symbol_registry_diff": f"""WITH {NAMED}, active AS (SELECT DISTINCT l_returnflag AS symbol FROM lineitem)
SELECT symbol, CASE WHEN a.symbol IS NULL THEN 'missing' WHEN s.symbol IS NULL THEN 'unregistered' ELSE 'available' END AS state FROM symbols s FULL JOIN active a USING (symbol)""",
    "dq_duplicate_epochs": f"WITH {TICKS} SELECT symbol, epoch, count(*) AS n FROM ticks GROUP BY ALL HAVING n > 1",
    "dq_non_monotonic": f"WITH {TICKS}, p AS (SELECT *, lag(epoch) OVER (PARTITION BY symbol ORDER BY arrival) AS previous_epoch FROM ticks) SELECT symbol, arrival, previous_epoch, epoch FROM p WHERE epoch < previous_epoch",
    "dq_invalid_prices": f"""WITH {TICKS} SELECT symbol, epoch, 'quote' AS field, CASE CAST(tick_id AS BIGINT) % 6 WHEN 2 THEN 'nan' WHEN 3 THEN 'null' WHEN 4 THEN 'inf' ELSE 'not positive' END AS kind FROM ticks WHERE CAST(tick_id AS BIGINT) % 6 <> 5 AND NOT (CAST(tick_id AS BIGINT) % 6 = 1 AND quote < 0) OR CAST(tick_id AS BIGINT) % 6 = 5 AND quote <= 0""",
    "dq_abnormal_jumps": f"""WITH {TICKS}, p AS (SELECT *, lag(epoch) OVER q AS pe, lag(quote) OVER q AS pq FROM ticks WHERE quote > 0 WINDOW q AS (PARTITION BY symbol ORDER BY arrival)),
k AS (SELECT *, ln(quote / pq) AS r FROM p WHERE epoch > pe),
s AS (SELECT *, stddev_pop(r) OVER q AS sd, count(r) OVER q AS seen FROM k WINDOW q AS (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
SELECT symbol, arrival, epoch, CASE WHEN sd = 0 AND r <> 0 THEN 'zero-variance-break' ELSE 'sigma-threshold' END AS kind, round(r, 6) + 0.0 AS r FROM s WHERE seen >= 2 AND ((sd = 0 AND r <> 0) OR abs(r) > 3.0 * sd)""",
    "dq_daily_coverage": f"WITH {COVERAGE} SELECT symbol, day, expected, observed, round(coverage, 6) + 0.0 AS coverage FROM coverage",
    "dq_coverage_rollup": f"WITH {COVERAGE} SELECT symbol, CAST(sum(observed) AS BIGINT) AS observed, CAST(sum(expected) AS BIGINT) AS expected, round(100.0 * sum(observed) / sum(expected), 6) + 0.0 AS coverage FROM coverage GROUP BY symbol",
    "find_gaps": f"WITH {HOURLY}, e AS (SELECT symbol, unnest(range(1703980800, 1707004800, 3600)) AS epoch FROM (SELECT DISTINCT symbol FROM hourly)) SELECT symbol, epoch FROM e ANTI JOIN hourly USING (symbol, epoch)",
    "gap_count": f"WITH {HOURLY} SELECT symbol, CAST((max(epoch) - min(epoch)) // 3600 + 1 - count(*) AS BIGINT) AS missing FROM hourly GROUP BY symbol",
    "segment_islands": f"WITH {HOURLY}, {segments('hourly', 3600)} SELECT symbol, segment, count(*) AS n, max(epoch) AS last FROM seg GROUP BY ALL",
    "ind_log_return": f"{BASE} SELECT symbol, epoch, {unsigned('r')} AS r FROM ret",
    "ind_bollinger_z": f"{BASE} SELECT symbol, epoch, {unsigned(Z)} AS z FROM ret",
    "ind_realized_vol": rolling("vol", f"stddev_samp(r) {w(20)} * sqrt({YEAR})", 20),
    "ind_realized_vol_elapsed": f"{BASE} SELECT symbol, epoch, {unsigned(ELAPSED)} AS vol FROM ret",
    "ind_parkinson": rolling("vol", f"sqrt(avg(x) {w(20)} / (4 * ln(2))) * sqrt({YEAR})", 20, "x", "(SELECT *, pow(ln(high / low), 2) AS x FROM ret)"),
    "ind_autocorr": f"{BASE} SELECT symbol, epoch, {unsigned(pearson(49))} AS autocorr FROM (SELECT *, lag(r) {O} AS y FROM ret)",
    "ind_variance_ratio": f"{BASE} SELECT symbol, epoch, {unsigned(vr(100))} AS vr FROM {sums(2)}",
    "ind_hurst_vr": f"{BASE} SELECT symbol, epoch, {unsigned(full(f'CASE WHEN var_samp(r) {w(100)} > 0 AND var_samp(s) {w(99)} > 0 THEN ln(var_samp(s) {w(99)} / var_samp(r) {w(100)}) / (2 * ln(2)) END', 100))} AS hurst FROM {sums(2)}",
    "ind_hurst_rs": f"{BASE}, {RS} SELECT symbol, epoch, {unsigned('hurst')} AS hurst FROM ret LEFT JOIN hurst USING (symbol, epoch)",
    "ind_skew": rolling("skew", f"CASE WHEN var_pop(r) {w(20)} > 0 THEN skewness(r) {w(20)} ELSE 0.0 END", 20),
    "ind_kurtosis": rolling("kurtosis", f"CASE WHEN var_pop(r) {w(20)} > 0 THEN kurtosis(r) {w(20)} ELSE -3.0 END", 20),
    "ind_ema": f"{BASE}, {ema(14)} SELECT symbol, epoch, {unsigned('CASE WHEN i >= 13 THEN y END')} AS ema FROM run",
    "ind_rsi": f"{BASE}, {RSI} SELECT symbol, epoch, {unsigned(RSI_VALUE)} AS rsi FROM run",
    "ind_atr": f"{BASE}, {ATR} SELECT symbol, epoch, {unsigned('CASE WHEN i >= 13 THEN y END')} AS atr FROM run",
    "screen_features": f"{FEATURES} SELECT {FEATURE_COLUMNS} FROM features",
    "flags_causal": f"{FEATURES} SELECT * FROM flags",
    "screen_latest": f"""{SCREEN}, sizes AS (SELECT symbol, count(CASE WHEN part = 'calibration' THEN 1 END) AS calibration_candles, count(CASE WHEN part = 'holdout' THEN 1 END) AS holdout_candles, count(CASE WHEN part = 'display' THEN 1 END) AS display_candles FROM splits GROUP BY symbol),
top AS (SELECT * FROM features JOIN flags USING (symbol, epoch) WHERE symbol LIKE '%|display' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY epoch DESC) = 1)
SELECT {FEATURE_COLUMNS.replace('symbol, epoch', 'sizes.symbol AS symbol, epoch', 1)}, {TREND} AS trend, concat_ws(',', {', '.join(f"CASE WHEN {f} THEN '{f}' END" for f in FLAGS)}) AS flags, calibration_candles, holdout_candles, display_candles FROM top JOIN sizes ON sizes.symbol = split_part(top.symbol, '|', 1)""",
    "screen_reliability": f"{MARKS} SELECT symbol, flag, observations, CASE WHEN observations >= 5 THEN round(edge, 6) + 0.0 END AS edge, CASE WHEN observations >= 5 THEN round(hit_rate, 6) + 0.0 END AS hit_rate FROM reliable",
    "latest_n": f"WITH {DAILY} SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY epoch DESC) AS INTEGER) AS rank FROM daily QUALIFY rank <= 20",
    "split_calibration": f"WITH {PARTS} SELECT symbol, epoch, part FROM splits",
    "trades_h1": f"{BASE}, {trades(1)} SELECT {TRADE_COLUMNS} FROM trades",
    "trades_h5": f"{BASE}, {trades(5)} SELECT {TRADE_COLUMNS} FROM trades",
    "trades_fixed_payout": f"{BASE}, {trades(1, fixed=True, stake=20.0, commission=0.2, spread=0.01)} SELECT {TRADE_COLUMNS} FROM trades",
    "backtest_report": f"{BASE}, {trades(1)}, {EVALUATED}, {report('symbol')} SELECT symbol, {REPORT_COLUMNS} FROM report LEFT JOIN zs USING (symbol)",
    "backtest_drawdown": f"""{BASE}, {trades(1)}, q AS (SELECT symbol, decision, 10000.0 + sum(net) OVER (PARTITION BY symbol ORDER BY decision) AS equity FROM trades),
p AS (SELECT *, greatest(10000.0, max(equity) OVER (PARTITION BY symbol ORDER BY decision)) AS peak FROM q) SELECT symbol, round(max((peak - equity) / peak), 6) + 0.0 AS drawdown FROM p GROUP BY symbol""",
    "wf_splits": f"""WITH {DAILY}, n AS (SELECT symbol, count(*) AS n FROM daily GROUP BY symbol), f AS (SELECT symbol, n, unnest(range(500, n, 200)) AS train_end FROM n)
SELECT symbol, CAST((train_end - 500) // 200 AS INTEGER) AS fold, train_end, train_end AS test_start, least(train_end + 250, n) AS test_end FROM f""",
    "vol_monitor": f"{BASE}, {monitor(500)} SELECT {MONITOR_COLUMNS} FROM monitor",
    "ljung_box": f"""{BASE}, l AS (SELECT symbol, r, {', '.join(f'lag(r, {k}) {O} AS l{k}' for k in range(1, 6))} FROM ret), m AS (SELECT symbol, count(r) AS n, avg(r) AS m, var_pop(r) AS v FROM ret GROUP BY symbol)
SELECT symbol, n, round(n * (n + 2) * ({' + '.join(f'pow(sum((r - m) * (l{k} - m)) / (n * v), 2) / (n - {k})' for k in range(1, 6))}), 6) + 0.0 AS q FROM l JOIN m USING (symbol) WHERE r IS NOT NULL GROUP BY symbol, n, v""",
    "runs_test": f"""{BASE}, s AS (SELECT symbol, epoch, sign(r) AS s FROM ret WHERE r <> 0), c AS (SELECT *, lag(s) OVER (PARTITION BY symbol ORDER BY epoch) AS ps FROM s),
t AS (SELECT symbol, CAST(sum((s > 0)::INT) AS BIGINT) AS up, CAST(sum((s < 0)::INT) AS BIGINT) AS down, CAST(sum((ps IS NULL OR s <> ps)::INT) AS BIGINT) AS runs FROM c GROUP BY symbol),
z AS (SELECT *, (up + down)::DOUBLE AS n, 2.0::DOUBLE * up * down AS b FROM t)
SELECT symbol, up, down, runs, round(coalesce(greatest(0, abs(runs - (b / n + 1)) - 0.5) * sign(runs - (b / n + 1)) / sqrt(b * (b - n) / (n * n * (n - 1))), 0), 6) + 0.0 AS z FROM z""",
    "signal_eval": signal_eval(5),
    "xsym_corr": f"""{BASE}, p AS (SELECT a.symbol AS one, b.symbol AS two, a.r AS x, b.r AS y FROM ret a JOIN ret b USING (epoch) WHERE a.symbol < b.symbol AND a.r IS NOT NULL AND b.r IS NOT NULL)
SELECT one, two, count(*) AS n, round(corr(x, y), 6) + 0.0 AS correlation, round(4 / sqrt(count(*)), 6) + 0.0 AS threshold FROM p GROUP BY ALL""",
    "bh_adjust": f"""WITH {DAILY}, c AS (SELECT symbol, CAST(floor(epoch / 31557600) AS BIGINT) AS year, count(*) AS n, count(CASE WHEN close > open THEN 1 END) AS k FROM daily GROUP BY ALL),
p AS (SELECT symbol, year, n, k, least(1.0, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))))) AS p FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM p)
SELECT symbol, year, n, k, round(p, 6) + 0.0 AS p, round(least(1.0, min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS q, round(least(1.0, p * m), 6) + 0.0 AS bonferroni FROM r""",
    "ledger_directions": f"{FEATURES}, {CALLS} SELECT * FROM calls",
    "ledger_summary": f"""{FEATURES}, {CALLS}, {SCORES}, t AS (SELECT n.strategy, count(CASE WHEN outcome IN ('win', 'loss') THEN 1 END) AS calls, count(CASE WHEN outcome = 'win' THEN 1 END) AS wins, count(CASE WHEN outcome = 'void' THEN 1 END) AS voids, count(CASE WHEN outcome = 'pending' THEN 1 END) AS pending FROM (VALUES ('trend'), ('reversion'), ('rsi'), ('coin')) n(strategy) LEFT JOIN scores s ON s.strategy = n.strategy GROUP BY n.strategy),
p AS (SELECT *, CASE WHEN calls > 0 THEN {tail('wins', 'calls', '(1 / 1.95::DOUBLE)')} END AS p FROM t)
SELECT strategy, calls, wins, voids, pending, round(wins / nullif(calls, 0), 6) + 0.0 AS hit_rate, round(1 / 1.95::DOUBLE, 6) AS break_even, round(p, 6) + 0.0 AS p, CASE WHEN p IS NOT NULL THEN round(least(1.0, 3 * p), 6) + 0.0 END AS adjusted_p,
CASE WHEN strategy = 'coin' THEN 'control' WHEN calls < 200 THEN 'collecting data' WHEN 3 * p < 0.05 THEN 'edge detected' ELSE 'no edge detected' END AS verdict FROM p""",
    "size_positions": f"""{BASE}, v AS (SELECT symbol, epoch, {full(f'stddev_samp(r) {w(5)} * sqrt(365)', 5)} AS stated_vol FROM ret), symbols AS (SELECT symbol, arg_max(stated_vol, epoch) AS stated_vol FROM v WHERE stated_vol IS NOT NULL GROUP BY symbol), s AS (SELECT *, 10000.0 * 0.1 / (stated_vol * 2) AS free FROM symbols), r AS (SELECT *, (free * 0.502 + 0.2) / 10000 AS risk FROM s), c AS (SELECT *, CASE WHEN risk <= 0.02 THEN free ELSE (200.0 - 0.2) / 0.502 END AS stake FROM r)
SELECT symbol, round(stake, 6) + 0.0 AS vol_target_stake, round(risk, 6) + 0.0 AS vol_target_requested, round((stake * 0.502 + 0.2) / 10000, 6) + 0.0 AS vol_target_risk, round(stake * 2 * stated_vol / 10000, 6) + 0.0 AS expected_volatility, round((200.0 - 0.2) / 0.502, 6) + 0.0 AS fixed_fraction_stake, true AS fixed_fraction_capped, round(stake * 0.502 + 0.2, 6) + 0.0 AS max_loss FROM c""",
    "size_kelly": f"""{BASE}, {trades(1, stop=1.0, commission=0.0, spread=0.0)}, w AS (SELECT symbol, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS p FROM trades GROUP BY symbol), k AS (SELECT symbol, greatest(0, p - (1 - p) / 1.5) * 0.5 AS f FROM w)
SELECT symbol, round(f, 6) + 0.0 AS requested, round(least(f, 0.02), 6) + 0.0 AS applied, round(stake, 6) + 0.0 AS stake, round(stake / 10000, 6) + 0.0 AS equity_fraction, round(CASE WHEN f > 0 THEN (stake * 0.502 + 0.2) / 10000 ELSE 0 END, 6) + 0.0 AS risk, f > 0.02 AS capped
FROM (SELECT *, CASE WHEN f > 0 THEN (least(f, 0.02) * 10000 - 0.2) / 0.502 ELSE 0 END AS stake FROM k)""",
    "circuit_breaker_running": f"""{HOURS}, d AS (SELECT *, exit_epoch // 86400 AS day, sum((net >= 0)::INT) OVER (PARTITION BY symbol ORDER BY exit_epoch) AS spell FROM trades),
r AS (SELECT *, sum(net) OVER (PARTITION BY symbol, day ORDER BY exit_epoch) AS daily_net, CAST(sum((net < 0)::INT) OVER (PARTITION BY symbol, spell ORDER BY exit_epoch) AS BIGINT) AS losses FROM d)
SELECT symbol, exit_epoch, day, round(net, 6) + 0.0 AS net, round(daily_net, 6) + 0.0 AS daily_net, losses, concat_ws(',', CASE WHEN daily_net <= -15 THEN 'daily-loss-limit' END, CASE WHEN losses >= 3 THEN 'consecutive-loss-limit' END) AS reasons FROM r""",
    "circuit_breaker_fold": f"""{HOURS}, t AS (SELECT symbol, exit_epoch, net, exit_epoch // 86400 AS day, row_number() OVER (PARTITION BY symbol ORDER BY exit_epoch) AS k FROM trades),
fold AS (SELECT symbol, k - 1 AS k, day, exit_epoch, false AS taken, 0.0::DOUBLE AS total, 0 AS losses FROM t WHERE k = 1
  UNION ALL SELECT symbol, k, day, exit_epoch, ok, before + CASE WHEN ok THEN net ELSE 0 END, CASE WHEN NOT ok THEN losses WHEN net < 0 THEN losses + 1 ELSE 0 END FROM (
    SELECT *, before > -15 AND losses < 12 AS ok FROM (SELECT t.*, f.losses, CASE WHEN t.day = f.day THEN f.total ELSE 0 END AS before FROM fold f JOIN t ON t.symbol = f.symbol AND t.k = f.k + 1)))
SELECT symbol, exit_epoch, taken, {unsigned('total')} AS daily_net, losses FROM fold WHERE k > 0""",
}


def outcomes(h: int, name: str, value: float) -> str:
    """Trades of every candle, and the row numbers that tell splits and the distance from a run's first candle in its split."""
    ahead = f"OVER (PARTITION BY symbol, run, split ORDER BY place ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"""SELECT symbol, epoch AS decision, {h} AS horizon, '{name}' AS direction, split, {value} * 5.0 * 10000 AS k, leave, entry, lo, hi FROM (
SELECT *, lead(open) OVER (PARTITION BY symbol, run, split ORDER BY place) AS entry, lead(close, {h}) OVER (PARTITION BY symbol, run, split ORDER BY place) AS leave, min(low) {ahead} AS lo, max(high) {ahead} AS hi FROM runs)
WHERE inside % {h} = 0 AND leave IS NOT NULL AND entry > 0"""


EDGE = f"""places AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY epoch) - 1 AS place, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY epoch) - 1 < floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE) THEN 'discovery' ELSE 'confirmation' END AS split FROM seg),
runs AS (SELECT symbol, epoch, open, high, low, close, place, split, segment AS run, row_number() OVER (PARTITION BY symbol, segment, split ORDER BY epoch) - 1 AS inside FROM places),
paths AS ({' UNION ALL '.join(outcomes(h, d, v) for h in (1, 5, 15) for d, v in (('long', 1.0), ('short', -1.0)))}),
settled AS (SELECT *, CASE WHEN k / 10000 * ((CASE WHEN k > 0 THEN lo ELSE hi END) - entry) / entry <= -0.5 THEN -5000.0 ELSE k * (leave - entry) / entry END AS gross FROM paths),
edges AS (SELECT symbol, decision, horizon, direction, split, gross, gross - 200.0 AS net FROM settled)"""
LONG = "long AS (SELECT symbol, epoch AS decision, flag FROM (UNPIVOT flags ON overbought, stretched, vol_mismatch, trending_regime, mean_reverting_regime INTO NAME flag VALUE yes) WHERE yes)"


GRID = f"""grid AS (SELECT symbol, flag, horizon, direction, split FROM (SELECT DISTINCT symbol FROM daily), unnest({list(FLAGS)!r}) a(flag), unnest([1, 5, 15]) b(horizon), unnest(['long', 'short']) c(direction), unnest(['discovery', 'confirmation']) d(split)),
signalled AS (SELECT long.symbol AS symbol, flag, split, count(*) AS n_signals FROM long JOIN places ON places.symbol = long.symbol AND places.epoch = long.decision GROUP BY ALL),
joined AS (SELECT symbol, flag, horizon, direction, split, gross, net FROM edges JOIN long USING (symbol, decision)),
hypotheses AS (
  SELECT symbol, flag, horizon, direction, split, count(net) AS n_effective, count(CASE WHEN net <> 0 THEN 1 END) AS n_non_tied, count(CASE WHEN net > 0 THEN 1 END) AS wins, avg(gross) AS gross_mean_bps, avg(net) AS net_mean_bps, 'symbol' AS scope FROM grid LEFT JOIN joined USING (symbol, flag, horizon, direction, split) GROUP BY ALL
  UNION ALL SELECT 'ALL', flag, horizon, direction, split, count(net), count(CASE WHEN net <> 0 THEN 1 END), count(CASE WHEN net > 0 THEN 1 END), avg(gross), avg(net), 'pooled' FROM (SELECT DISTINCT flag, horizon, direction, split FROM grid) LEFT JOIN joined USING (flag, horizon, direction, split) GROUP BY ALL),
rows AS (SELECT h.*, wins / nullif(n_non_tied, 0) AS hit_rate, CAST(coalesce(CASE WHEN scope = 'symbol' THEN s.n_signals ELSE (SELECT sum(n_signals) FROM signalled t WHERE t.flag = h.flag AND t.split = h.split) END, 0) AS BIGINT) AS n_signals FROM hypotheses h LEFT JOIN signalled s USING (symbol, flag, split))"""
ROW_COLUMNS = f"scope, symbol, flag, horizon, direction, split, n_signals, n_effective, n_non_tied, wins, {unsigned('gross_mean_bps')} AS gross_mean_bps, {unsigned('net_mean_bps')} AS net_mean_bps, {unsigned('hit_rate')} AS hit_rate"
HYPOTHESES = f"{FEATURES}, {EDGE}, {LONG}, {GRID}"
TESTS = f"{HYPOTHESES}, tests AS (SELECT * FROM {adjusted(f'(SELECT *, CASE WHEN n_non_tied > 0 THEN {tail("wins", "n_non_tied", "0.5::DOUBLE")} ELSE 1.0 END AS binomial_p FROM rows)', 'binomial_p', 'binomial_adjusted_p')})"


def payout_table(name: str, payout: float) -> str:
    need = f"(1 / {1 + payout}::DOUBLE)"
    inner = f"(SELECT *, wins / n_non_tied AS win_rate, {need} AS break_even, wins / n_non_tied * {payout} - (1 - wins / n_non_tied) AS expected_value, {tail('wins', 'n_non_tied', need)} AS p FROM rows WHERE n_non_tied > 0)"
    return f"{name} AS (SELECT * FROM {adjusted(inner)})"


PAYOUTS = f"{HYPOTHESES}, {payout_table('be', 0.95)}"
PAYOUT_COLUMNS = f"{ROW_COLUMNS}, {unsigned('win_rate')} AS win_rate, {unsigned('break_even')} AS break_even, {unsigned('expected_value')} AS expected_value, {unsigned('p')} AS p, {unsigned('q')} AS q"
SHIFTED = f"""{FEATURES}, {EDGE}, all_flags AS (SELECT symbol, epoch AS decision, flag, coalesce(yes, false) AS on_ FROM flags UNPIVOT INCLUDE NULLS (yes FOR flag IN ({', '.join(FLAGS)}))),
series AS (SELECT e.symbol, flag, horizon, direction, split, net, on_, row_number() OVER (PARTITION BY e.symbol, flag, horizon, direction, split ORDER BY decision) - 1 AS i, count(*) OVER (PARTITION BY e.symbol, flag, horizon, direction, split) AS n FROM edges e JOIN all_flags f USING (symbol, decision)),
shifted AS (SELECT l.symbol, l.flag, l.horizon, l.direction, l.split, k, sum(s.net) AS total FROM (SELECT *, unnest(range(0, n)) AS k FROM series WHERE on_) l JOIN series s ON s.symbol = l.symbol AND s.flag = l.flag AND s.horizon = l.horizon AND s.direction = l.direction AND s.split = l.split AND s.i = (l.i + l.k) % l.n GROUP BY ALL),
own AS (SELECT symbol, flag, horizon, direction, split, total AS observed FROM shifted WHERE k = 0),
ps AS (SELECT symbol, flag, horizon, direction, split, CASE WHEN count(*) < 2 THEN 1.0 ELSE count(CASE WHEN k = 0 OR total >= observed - 1e-6 THEN 1 END) / count(*) END AS p FROM shifted JOIN own USING (symbol, flag, horizon, direction, split) GROUP BY ALL)"""
TWO_STRATEGIES = "strategies AS (SELECT epoch, avg(close / open - 1) AS body, avg(open / close - 1) AS fade FROM daily GROUP BY epoch)"
LJUNG = f"""lags AS (SELECT symbol, r, {', '.join(f'lag(r, {k}) {O} AS l{k}' for k in range(1, 6))} FROM ret), ends AS (SELECT symbol, count(r) AS n, avg(r) AS m, var_pop(r) AS v, var_samp(r) AS vs FROM ret GROUP BY symbol),
ljung AS (SELECT symbol, n * (n + 2) * ({' + '.join(f'pow(sum((r - m) * (l{k} - m)) / (n * v), 2) / (n - {k})' for k in range(1, 6))}) AS x FROM lags JOIN ends USING (symbol) WHERE r IS NOT NULL GROUP BY symbol, n, v)"""
BATTERY = f"""{BASE}, {LJUNG}, s AS (SELECT symbol, epoch, sign(r) AS s FROM ret WHERE r <> 0), c AS (SELECT *, lag(s) OVER (PARTITION BY symbol ORDER BY epoch) AS ps FROM s),
t AS (SELECT symbol, sum((s > 0)::INT)::DOUBLE AS up, sum((s < 0)::INT)::DOUBLE AS down, sum((ps IS NULL OR s <> ps)::INT)::DOUBLE AS runs FROM c GROUP BY symbol), g AS (SELECT *, up + down AS n, 2 * up * down AS b FROM t),
runs AS (SELECT symbol, coalesce(greatest(0, abs(runs - (b / n + 1)) - 0.5) * sign(runs - (b / n + 1)) / sqrt(b * (b - n) / (n * n * (n - 1))), 0) AS x FROM g),
ratio AS (SELECT symbol, coalesce((sum(pow(s - 2 * m, 2)) / (2 * (n - 1) * (1 - 2.0::DOUBLE / n)) / nullif(vs, 0) - 1) / sqrt(6.0::DOUBLE / (6 * n)), 0) AS x FROM {sums(2)} JOIN ends USING (symbol) WHERE r IS NOT NULL GROUP BY symbol, n, vs HAVING n > 2),
arch AS (SELECT symbol, greatest(0, count(*) * regr_r2(y, x)) AS x FROM (SELECT symbol, r * r AS y, lag(r * r) {O} AS x FROM ret) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY symbol),
tests AS (SELECT symbol, 'ljung_box' AS test, x AS statistic, {chi2_sf('x', '5')} AS p FROM ljung UNION ALL SELECT symbol, 'runs', x, 2 * (1 - {phi('abs(x)')}) FROM runs UNION ALL SELECT symbol, 'variance_ratio', x, 2 * (1 - {phi('abs(x)')}) FROM ratio UNION ALL SELECT symbol, 'arch_lm', x, {chi2_sf('x', '1')} FROM arch)
SELECT symbol, test, round(statistic, 6) + 0.0 AS statistic, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q, q <= 0.05 AS reject FROM {adjusted('(SELECT symbol, test, statistic, greatest(p, 0) AS p FROM tests)')}"""


def day_report(table: str, step: int) -> str:
    """Findings and the least daily coverage of a table of candles, between the first and last candle of all."""
    return f"""{table}_ends AS (SELECT min(epoch) AS low, max(epoch) AS high FROM {table}), {table}_days AS (SELECT symbol, day, greatest(low, day * 86400) AS a, least(high, day * 86400 + 86399) AS b FROM (SELECT DISTINCT symbol FROM {table}), (SELECT low, high, unnest(range(low // 86400, high // 86400 + 1)) AS day FROM {table}_ends)),
{table}_cover AS (SELECT symbol, min(CASE WHEN want = 0 THEN 100.0 ELSE 100.0 * coalesce(seen, 0) / want END) AS coverage FROM (SELECT symbol, day, greatest(0, b // {step} - (a + {step - 1}) // {step} + 1) AS want FROM {table}_days) LEFT JOIN (SELECT symbol, epoch // 86400 AS day, count(*) AS seen FROM {table} WHERE epoch % {step} = 0 GROUP BY ALL) USING (symbol, day) GROUP BY symbol),
{table}_report AS (SELECT symbol, 0::BIGINT AS duplicates, (count(CASE WHEN open <= 0 THEN 1 END) + count(CASE WHEN high <= 0 THEN 1 END) + count(CASE WHEN low <= 0 THEN 1 END) + count(CASE WHEN close <= 0 THEN 1 END))::BIGINT AS invalid, CAST((max(epoch) - min(epoch)) // {step} + 1 - count(*) AS BIGINT) AS gaps, any_value(coverage) AS coverage FROM {table} JOIN {table}_cover USING (symbol) GROUP BY symbol)"""


ORACLES |= {
    "variance_ratio_test": f"""{BASE}, e AS (SELECT symbol, count(r) AS n, avg(r) AS m, var_samp(r) AS v FROM ret GROUP BY symbol)
SELECT symbol, n, round(coalesce((sum(pow(s - 2 * m, 2)) / (2 * (n - 1) * (1 - 2.0::DOUBLE / n)) / nullif(v, 0) - 1) / sqrt(6.0::DOUBLE / (6 * n)), 0), 6) + 0.0 AS z FROM {sums(2)} JOIN e USING (symbol) WHERE r IS NOT NULL GROUP BY symbol, n, v HAVING n > 2""",
    "arch_lm": f"""{BASE}, l AS (SELECT symbol, r * r AS y, lag(r * r) {O} AS x FROM ret) SELECT symbol, count(*) AS n, round(greatest(0, count(*) * regr_r2(y, x)), 6) + 0.0 AS lm FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY symbol""",
    "vol_breach_rate": f"""{BASE}, {monitor(100)}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY epoch) - 1 AS place FROM monitor WHERE status = 'ok'), c AS (SELECT s.symbol, count(a.epoch) AS windows, count(CASE WHEN alert THEN 1 END) AS breaches FROM symbols s LEFT JOIN a ON a.symbol = s.symbol AND place % 100 = 0 GROUP BY s.symbol)
SELECT symbol, windows, breaches, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q FROM {adjusted(f"(SELECT *, CASE WHEN windows > 0 THEN {tail('breaches', 'windows', '0.01::DOUBLE')} ELSE 1.0 END AS p FROM c)")}""",
    "identical_ratio_pairs": f"""{BASE}, {monitor(100)}, t AS (SELECT symbol, arg_max(realized / stated_vol, epoch) AS x FROM monitor WHERE status = 'ok' GROUP BY symbol) SELECT count(*) AS pairs FROM t a JOIN t b ON a.symbol < b.symbol AND round(a.x, 3) = round(b.x, 3)""",
    "edge_candidates": f"{BASE}, {EDGE} SELECT symbol, decision, horizon, direction, split, {unsigned('gross')} AS gross, {unsigned('net')} AS net FROM edges",
    "edge_symbol_rows": f"{HYPOTHESES} SELECT {ROW_COLUMNS} FROM rows WHERE scope = 'symbol'",
    "edge_pooled_rows": f"{HYPOTHESES} SELECT {ROW_COLUMNS} FROM rows WHERE scope = 'pooled'",
    "payout_breakeven": f"{PAYOUTS} SELECT {PAYOUT_COLUMNS} FROM be",
    "payout_top8": f"{PAYOUTS} SELECT {PAYOUT_COLUMNS} FROM be WHERE n_non_tied >= 30 ORDER BY round(be.p, 6), round(be.expected_value, 9) DESC, scope, symbol, flag, horizon, direction, split LIMIT 8",
    "data_window": f"WITH {DAILY}, e AS (SELECT symbol, count(*) AS n, min(epoch) AS a, max(epoch) AS b FROM daily GROUP BY symbol) SELECT min(n) AS candles, max(a) AS first_epoch, min(b) AS last_epoch FROM e",
    "technical_read": f"""{SCREEN}, t AS (SELECT *, {TREND} AS label FROM features WHERE symbol LIKE '%|display' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY epoch DESC) = 1),
r AS (SELECT split_part(symbol, '|', 1) AS symbol, round(close, 6) + 0.0 AS price, CASE WHEN label = 'ema20_above_ema50' THEN 'up (short average above long)' WHEN label = 'ema20_below_ema50' THEN 'down (short average below long)' ELSE 'unclear' END AS trend,
coalesce(CASE WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN 'overbought' ELSE 'neutral' END || printf(' (RSI %.0f)', rsi), 'n/a') AS momentum,
coalesce(CASE WHEN z >= 2 THEN 'far above average' WHEN z >= 1 THEN 'above average' WHEN z <= -2 THEN 'far below average' WHEN z <= -1 THEN 'below average' ELSE 'near average' END || printf(' (z %+.1f)', z), 'n/a') AS stretch,
coalesce(CASE WHEN vol_ratio > 1.15 THEN 'running hotter than stated' WHEN vol_ratio < 0.85 THEN 'running cooler than stated' ELSE 'as stated' END || printf(' (%.2fx)', vol_ratio), 'n/a') AS volatility,
CASE WHEN hurst IS NULL OR vr IS NULL OR autocorr IS NULL THEN 'n/a' WHEN hurst BETWEEN 0.45 AND 0.55 AND vr BETWEEN 0.85 AND 1.15 AND abs(autocorr) < 0.1 THEN 'consistent with a random walk' ELSE 'small deviation from random walk (usually noise)' END AS behaviour,
concat_ws(',', CASE WHEN ema20 > ema50 THEN 'trend:long' WHEN ema20 < ema50 THEN 'trend:short' END, CASE WHEN z <= -1 THEN 'reversion:long' WHEN z >= 1 THEN 'reversion:short' END, CASE WHEN rsi < 30 THEN 'rsi:long' WHEN rsi > 70 THEN 'rsi:short' END) AS calls FROM t)
SELECT *, 'Trend ' || trend || '; momentum ' || momentum || '; price ' || stretch || '.' AS headline FROM r""",
    "store_scan": f"WITH {DAILY} SELECT * FROM daily WHERE symbol = 'A' AND epoch BETWEEN 820454400 AND 852076800",
    "upsert_candles": f"WITH {DAILY}, {HOURLY} SELECT *, 86400 AS granularity FROM daily UNION ALL SELECT symbol, epoch, {unsigned('open')}, {unsigned('high')}, {unsigned('low')}, {unsigned('close')}, 3600 FROM hourly",
    "export_parquet_roundtrip": f"WITH {DAILY} SELECT * FROM daily",
    "parse_history_json": f"""WITH {TICKS} SELECT symbol, epoch // 86400 AS page, epoch, {unsigned('quote')} AS quote FROM ticks UNION ALL SELECT symbol, epoch // 86400 - 1, epoch, {unsigned('quote')} FROM ticks WHERE epoch % 86400 < 600""",
    "history_pages_dedup": f"WITH {TICKS} SELECT DISTINCT symbol, epoch, {unsigned('quote')} AS quote FROM ticks WHERE epoch BETWEEN 1704672000 AND 1705276800",
    "candle_pages_dedup": f"WITH {DAILY} SELECT symbol, epoch, {unsigned('open')} AS open, {unsigned('high')} AS high, {unsigned('low')} AS low, {unsigned('close + CASE WHEN epoch % 31536000 < 2592000 THEN 1 ELSE 0 END')} AS close FROM daily WHERE epoch BETWEEN 820454400 AND 852076800",
    "parse_report_header": f"""WITH {DAILY}, {HOURLY} SELECT 'daily' AS name, strftime(make_timestamp(max(last) * 1000000), '%Y-%m-%d') AS report_date, 0.05::DOUBLE AS alpha, CAST(sum(n) AS BIGINT) AS rows_per_family, CAST(sum(up) AS BIGINT) AS bonferroni, count(*) AS replications, max(n) AS tests, CAST(sum(down) AS BIGINT) AS confirmed_null, round(round(100 * sum(up) / sum(n), 3) / 100, 6) + 0.0 AS raw_significant, round(round(100 * sum(down) / sum(n), 3) / 100, 6) + 0.0 AS bh_surviving, CAST(count(*) AS INTEGER) AS symbols, min(n) AS candles, max(first) AS first_epoch, min(last) AS last_epoch FROM (SELECT symbol, count(*) AS n, min(epoch) AS first, max(epoch) AS last, count(CASE WHEN close > open THEN 1 END) AS up, count(CASE WHEN close < open THEN 1 END) AS down FROM daily GROUP BY symbol)
UNION ALL SELECT 'hourly' AS name, strftime(make_timestamp(max(last) * 1000000), '%Y-%m-%d') AS report_date, 0.05::DOUBLE AS alpha, CAST(sum(n) AS BIGINT) AS rows_per_family, CAST(sum(up) AS BIGINT) AS bonferroni, count(*) AS replications, max(n) AS tests, CAST(sum(down) AS BIGINT) AS confirmed_null, round(round(100 * sum(up) / sum(n), 3) / 100, 6) + 0.0 AS raw_significant, round(round(100 * sum(down) / sum(n), 3) / 100, 6) + 0.0 AS bh_surviving, CAST(count(*) AS INTEGER) AS symbols, min(n) AS candles, max(first) AS first_epoch, min(last) AS last_epoch FROM (SELECT symbol, count(*) AS n, min(epoch) AS first, max(epoch) AS last, count(CASE WHEN close > open THEN 1 END) AS up, count(CASE WHEN close < open THEN 1 END) AS down FROM hourly GROUP BY symbol)""",
    "backfill_missing_epochs": f"""WITH {HOURLY}, l AS (SELECT symbol, min(epoch) AS first, max(epoch) AS last FROM hourly GROUP BY symbol), e AS (SELECT symbol, last, unnest(range(first, 1707004800, 3600)) AS epoch FROM l), m AS (SELECT * FROM e ANTI JOIN hourly USING (symbol, epoch)),
s AS (SELECT symbol, least(last - 7200, coalesce(min(CASE WHEN epoch < last THEN epoch END), last - 7200)) AS start FROM m GROUP BY symbol, last) SELECT symbol, epoch FROM m JOIN s USING (symbol) WHERE epoch >= start""",
    "backfill_coverage": f"WITH {HOURLY} SELECT symbol, 840::BIGINT AS expected, count(CASE WHEN epoch >= 1703980800 AND epoch < 1707004800 THEN 1 END) AS observed, round(100.0 * count(CASE WHEN epoch >= 1703980800 AND epoch < 1707004800 THEN 1 END) / 840, 6) + 0.0 AS coverage FROM hourly GROUP BY symbol",
    "dq_symbol_status": f"WITH {HOURLY}, {NAMED}, {day_report('hourly', 3600)} SELECT symbol, coverage, duplicates, invalid, gaps, CASE WHEN coverage IS NULL THEN 'missing' WHEN coverage >= 50 THEN 'healthy' ELSE 'degraded' END AS status FROM symbols LEFT JOIN (SELECT symbol, duplicates, invalid, gaps, round(coverage, 6) + 0.0 AS coverage FROM hourly_report) USING (symbol)".replace("SELECT symbol, coverage,", "SELECT symbols.symbol AS symbol, coverage,"),
    "dq_union_reports": f"WITH {HOURLY}, {DAILY}, {day_report('hourly', 3600)}, {day_report('daily', 86400)} SELECT symbol, duplicates, invalid, gaps, round(coverage, 6) + 0.0 AS coverage, 3600 AS granularity FROM hourly_report UNION ALL SELECT symbol, duplicates, invalid, gaps, round(coverage, 6) + 0.0, 86400 FROM daily_report",
    "ind_annualize": f"{BASE} SELECT symbol, {unsigned('stddev_samp(r) * sqrt(365)')} AS volatility FROM ret GROUP BY symbol",
    "causality": f"""WITH {DAILY}, ends AS (SELECT symbol, min(epoch) AS e0, max(epoch) AS e1 FROM daily GROUP BY symbol)
SELECT symbol, 20 AS cuts, count(*) AS compared, 0::BIGINT AS differing FROM daily JOIN ends USING (symbol), range(1, 21) t(k) WHERE epoch <= e0 + (e1 - e0) * k // 20 GROUP BY symbol""",
    "validated_trades": f"{BASE}, {trades(1)} SELECT {TRADE_COLUMNS} FROM trades",
    "flags_filled": f"{FEATURES} SELECT symbol, epoch, {', '.join(f'coalesce({f}, false) AS {f}' for f in FLAGS)} FROM flags",
    "screen_flags_array": f"""{SCREEN}, top AS (SELECT * FROM flags WHERE symbol LIKE '%|display' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY epoch DESC) = 1), l AS (SELECT split_part(symbol, '|', 1) AS symbol, list_filter([{', '.join(f"CASE WHEN {f} THEN '{f}' END" for f in FLAGS)}], lambda x: x IS NOT NULL) AS found FROM top)
SELECT symbol, CAST(generate_subscripts(found, 1) - 1 AS INTEGER) AS place, unnest(found) AS flag FROM l""",
    "last_segment": f"WITH {PARTS} SELECT symbol, count(*) AS n, min(epoch) AS first, max(epoch) AS last FROM runs_of_parts GROUP BY symbol",
    "seed_hash": f"WITH {DAILY}, {HOURLY}, names AS (SELECT symbol FROM daily UNION SELECT symbol FROM hourly) SELECT symbol, flag, CAST(12345 + list_sum(list_transform(range(1, length(symbol || flag) + 1), lambda i: i * ascii(substr(symbol || flag, i, 1)))) AS BIGINT) AS seed FROM names, unnest({list(FLAGS)!r}) t(flag)",
    "screen_shift_p_all": f"{TURNS} SELECT symbol, flag, round(p, 6) + 0.0 AS p FROM shifts",
    "screen_bh": f"{TURNS} SELECT symbol, flag, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q FROM {adjusted('(SELECT * FROM shifts WHERE p IS NOT NULL)')}",
    "trades_strided": f"{BASE}, {trades(5, signal='CASE WHEN place % 5 = 0 THEN CAST(sign(close - open) AS DOUBLE) ELSE 0 END').replace('FROM seg)', 'FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY epoch) - 1 AS place FROM seg))')} SELECT {TRADE_COLUMNS} FROM trades",
    "backtest_payout": f"{BASE}, {trades(1, fixed=True, stake=20.0, commission=0.2, spread=0.01)}, {EVALUATED}, {report('symbol', 20.0, need='(20 + 0.2 + 20 * 0.01) / (20 * 1.8)', trials_z=expected_maximum(20))} SELECT symbol, {REPORT_COLUMNS} FROM report LEFT JOIN zs USING (symbol)",
    "wf_backtest": f"""{BASE}, {trades(1)}, placed AS (SELECT symbol, epoch, row_number() OVER (PARTITION BY symbol ORDER BY epoch) - 501 AS place FROM daily), folds AS (SELECT symbol, epoch, CAST(place // 250 AS INTEGER) AS fold FROM placed WHERE place >= 0 AND place % 250 < 200),
evaluated AS (SELECT d.symbol, d.fold, d.epoch, net, missing FROM (SELECT *, {gaps_of('symbol, fold')} FROM folds) d LEFT JOIN trades t ON d.symbol = t.symbol AND d.epoch = t.entry_epoch), {report('symbol, fold')},
worth AS (SELECT symbol, fold, epoch, 10000.0 + sum(net) OVER (PARTITION BY symbol, fold ORDER BY epoch) AS equity FROM evaluated WHERE net IS NOT NULL), falls AS (SELECT symbol, fold, max((peak - equity) / peak) AS drawdown FROM (SELECT *, greatest(10000.0, max(equity) OVER (PARTITION BY symbol, fold ORDER BY epoch)) AS peak FROM worth) GROUP BY ALL),
{report('symbol').replace('moments AS', 'moments2 AS').replace('JOIN moments', 'JOIN moments2').replace('shapes AS', 'shapes2 AS').replace('FROM shapes', 'FROM shapes2').replace('zs AS', 'zs2 AS').replace('report AS', 'report2 AS')}
SELECT symbol, fold, {REPORT_COLUMNS}, round(coalesce(drawdown, 0), 6) + 0.0 AS drawdown FROM report LEFT JOIN zs USING (symbol, fold) LEFT JOIN falls USING (symbol, fold)
UNION ALL SELECT symbol, NULL, {REPORT_COLUMNS}, round(coalesce((SELECT max(drawdown) FROM falls f WHERE f.symbol = report2.symbol), 0), 6) + 0.0 FROM report2 LEFT JOIN zs2 USING (symbol)""",
    "dsr": f"{BASE}, {trades(1)}, {EVALUATED}, {report('symbol', trials_z=expected_maximum(10))} SELECT symbol, observations, round(z, 6) + 0.0 AS z, round(coalesce({phi('z')}, 0.5), 6) + 0.0 AS deflated_sharpe FROM report LEFT JOIN zs USING (symbol) WHERE observations > 0",
    "wrc_statistic": f"WITH {DAILY}, {TWO_STRATEGIES} SELECT round(greatest(avg(body), avg(fade)), 6) + 0.0 AS observed, 2::BIGINT AS strategies FROM strategies",
    "settle_returns": f"""WITH {DAILY}, m AS (SELECT *, d * (close - open) / open AS move, d * (CASE WHEN d > 0 THEN low ELSE high END - open) / open AS worst FROM daily, unnest([1.0::DOUBLE, -1.0::DOUBLE]) t(d) WHERE open > 0), g AS (SELECT *, CASE WHEN 50.0 * worst <= -5.0 THEN -5.0 ELSE 50.0 * move END AS gross FROM m)
SELECT symbol, epoch + 86400 AS decision, d AS direction, round(gross, 6) + 0.0 AS gross, round(gross - 0.2, 6) + 0.0 AS net, CASE WHEN 50.0 * worst <= -5.0 THEN 'stop_out' ELSE 'bar_close' END AS reason FROM g""",
    "portfolio_corr": f"{BASE}, shared AS (SELECT epoch FROM ret WHERE r IS NOT NULL GROUP BY epoch HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM daily)), a AS (SELECT x.symbol AS one, y.symbol AS two, x.r AS x, y.r AS y FROM ret x JOIN ret y ON x.epoch = y.epoch AND x.symbol < y.symbol JOIN shared b ON b.epoch = x.epoch) SELECT one, two, round(corr(x, y), 6) + 0.0 AS correlation FROM a GROUP BY one, two",
    "portfolio_risk": f"{BASE}, {NAMED}, shared AS (SELECT epoch FROM ret WHERE r IS NOT NULL GROUP BY epoch HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM daily)), a AS (SELECT x.symbol AS one, y.symbol AS two, x.r AS x, y.r AS y FROM ret x JOIN ret y ON x.epoch = y.epoch AND x.symbol < y.symbol JOIN shared b ON b.epoch = x.epoch), c AS (SELECT corr(x, y) AS c FROM a GROUP BY one, two), t AS (SELECT stated_vol FROM symbols SEMI JOIN daily USING (symbol)) SELECT (SELECT count(*) FROM shared) AS observations, round((SELECT sqrt(sum(stated_vol * stated_vol)) / count(*) FROM t), 6) + 0.0 AS annual_volatility, round(max(abs(c)), 6) + 0.0 AS max_correlation, max(abs(c)) > 0.05 AS warning FROM c",
    "vol_monitor_latest": f"{BASE}, {monitor(500)} SELECT {MONITOR_COLUMNS} FROM monitor QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY monitor.epoch DESC) = 1",
    "vol_variance_stat": f"{BASE}, {monitor(100)}, l AS (SELECT *, 99 * realized * realized / stated_vol / stated_vol AS statistic FROM monitor WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY epoch DESC) = 1), p AS (SELECT *, {chi2_sf('statistic', '99')} AS above FROM l) SELECT symbol, observations, round(statistic, 6) + 0.0 AS statistic, round(least(1.0, 2 * least(above, 1 - above)), 6) + 0.0 AS p FROM p",
    "signal_eval_h1": signal_eval(1),
    "ledger_record": f"{FEATURES}, {CALLS} SELECT symbol, epoch, strategy, direction, symbol || '|' || strategy || '|' || epoch AS id, 800000000::BIGINT AS recorded FROM calls WHERE epoch + 86400 > 800000000 AND strategy <> 'reversion'",
    "ledger_score": f"{FEATURES}, {CALLS}, {SCORES} SELECT symbol, epoch, strategy, direction, CASE WHEN outcome <> 'pending' OR age <= 259200 THEN round(entry, 6) + 0.0 END AS entry, CASE WHEN outcome <> 'pending' OR age <= 259200 THEN round(exit, 6) + 0.0 END AS exit, CASE WHEN outcome = 'pending' AND age > 259200 THEN 'void' ELSE outcome END AS outcome FROM (SELECT *, 852076800 - epoch AS age FROM scores)",
    "ledger_store": f"""{FEATURES}, {CALLS}, kept AS (SELECT c.*, e.open AS a, x.close AS b, CASE WHEN c.epoch + 6 * 86400 <= 808640000 THEN 'first' WHEN 8640000 > 259200 THEN 'expired' END AS how
  FROM calls c LEFT JOIN daily e ON e.symbol = c.symbol AND e.epoch = c.epoch + 86400 LEFT JOIN daily x ON x.symbol = c.symbol AND x.epoch = c.epoch + 5 * 86400 WHERE c.epoch + 86400 > 800000000)
SELECT symbol || '|' || strategy || '|' || epoch AS id, symbol, epoch, strategy, direction, 800000000::BIGINT AS recorded, CASE WHEN how = 'first' THEN round(a, 6) + 0.0 END AS entry, CASE WHEN how = 'first' THEN round(b, 6) + 0.0 END AS exit,
  CASE WHEN how = 'expired' OR a IS NULL OR b IS NULL THEN 'void' WHEN direction * (b - a) > 0 THEN 'win' ELSE 'loss' END AS outcome FROM kept""",
    "upsert_ties": f"""WITH {TICKS}, m AS (SELECT symbol, epoch - epoch % 60 AS epoch, quote, tick_id, CAST(tick_id AS BIGINT) AS number, arrival FROM ticks),
one AS (SELECT symbol, epoch, arg_max(quote, number) AS quote, arg_max(tick_id, number) AS tick_id FROM m GROUP BY ALL), two AS (SELECT symbol, epoch, arg_max(quote + 1, arrival) AS quote, arg_max(tick_id, arrival) AS tick_id FROM m WHERE epoch % 7200 < 3600 GROUP BY ALL)
SELECT symbol, epoch, {unsigned('coalesce(two.quote, one.quote)')} AS quote, coalesce(two.tick_id, one.tick_id) AS tick_id FROM one LEFT JOIN two USING (symbol, epoch)""",
    "history_paged_ticks": f"WITH {TICKS} SELECT DISTINCT symbol, epoch, round(quote, 6) + 0.0 AS quote FROM ticks WHERE epoch BETWEEN 1703980800 AND 1707004800",
    "history_paged_candles": f"WITH {DAILY} SELECT symbol, epoch, {unsigned('open')} AS open, {unsigned('high')} AS high, {unsigned('low')} AS low, {unsigned('close')} AS close FROM daily",
    "live_ticks": f"WITH {TICKS} SELECT symbol, epoch, round(quote, 6) + 0.0 AS quote, tick_id FROM ticks",
    "live_candles": f"WITH {HOURLY} SELECT symbol, epoch, {unsigned('open')} AS open, {unsigned('high')} AS high, {unsigned('low')} AS low, {unsigned('close')} AS close FROM hourly",
    "ledger_recent": f"{FEATURES}, {CALLS}, {SCORES} SELECT {SCORE_COLUMNS} FROM scores WHERE outcome <> 'pending' ORDER BY epoch DESC, symbol, strategy LIMIT 100",
    "edge_tests": f"{TESTS} SELECT {ROW_COLUMNS}, {unsigned('binomial_p')} AS binomial_p, {unsigned('binomial_adjusted_p')} AS binomial_adjusted_p FROM tests",
    "edge_csv_roundtrip": f"{HYPOTHESES} SELECT {ROW_COLUMNS} FROM rows",
    "edge_top15": f"{TESTS} SELECT {ROW_COLUMNS}, {unsigned('binomial_p')} AS binomial_p, {unsigned('binomial_adjusted_p')} AS binomial_adjusted_p FROM tests WHERE scope = 'pooled' ORDER BY round(tests.binomial_adjusted_p, 6), flag, horizon, direction, split LIMIT 15",
    "pooled_tests": f"""{TESTS}, w AS (SELECT flag, horizon, direction, max(CASE WHEN split = 'discovery' THEN net_mean_bps END) AS a, max(CASE WHEN split = 'confirmation' THEN net_mean_bps END) AS b, max(CASE WHEN split = 'confirmation' THEN round(binomial_adjusted_p, 6) + 0.0 END) AS confirmation_q, max(CASE WHEN split = 'confirmation' THEN n_effective END) AS n_effective FROM tests WHERE scope = 'pooled' GROUP BY ALL)
SELECT flag, horizon, direction, {unsigned('a')} AS discovery_net_bps, {unsigned('b')} AS confirmation_net_bps, confirmation_q, n_effective FROM w ORDER BY confirmation_q, flag, horizon, direction LIMIT 15""",
    "edge_confirmed": f"{TESTS} SELECT scope, symbol, flag, horizon, direction, count(CASE WHEN binomial_adjusted_p < 0.9 AND net_mean_bps > 0 THEN 1 END) = 2 AS confirmed FROM tests GROUP BY ALL",
    "payout_replicated": f"{PAYOUTS} SELECT flag, horizon, direction FROM be WHERE scope = 'pooled' GROUP BY ALL HAVING count(CASE WHEN n_non_tied >= 5 AND expected_value > 0 THEN 1 END) = 2",
    "payout_summary": f"{HYPOTHESES}, {payout_table('b1', 0.9)}, {payout_table('b2', 0.95)}, {payout_table('b3', 1.0)} "
    + " UNION ALL ".join(f"SELECT count(*) AS rows_tested, count(CASE WHEN win_rate > break_even THEN 1 END) AS rows_above_break_even, count(CASE WHEN q < 0.05 THEN 1 END) AS significant_rows, round(min(q), 6) + 0.0 AS least_q, {p}::DOUBLE AS payout FROM {t}" for t, p in (("b1", 0.9), ("b2", 0.95), ("b3", 1.0))),
    "edge_shift_p_all": f"{SHIFTED} SELECT s.symbol, s.flag, s.horizon, s.direction, s.split, round(coalesce(p, 1.0), 6) + 0.0 AS p FROM (SELECT DISTINCT symbol, flag, horizon, direction, split FROM series) s LEFT JOIN ps USING (symbol, flag, horizon, direction, split)",
    "randomness_battery": BATTERY,
}

"""Building blocks of the SQL that checks the Spark queries: named CTEs and how they follow each other."""

from __future__ import annotations

EPS = 0.1
DELTA = 0.1
ALPHA = 1.0

# name -> (needed blocks, body)
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, needs: tuple[str, ...], body: str) -> None:
    BLOCKS[name] = (needs, body)


def sql(final: str, *needs: str) -> str:
    """The final select after all blocks it needs, each once and in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in BLOCKS[name][0]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} as ({BLOCKS[n][1]})" for n in order)
    return f"with {ctes}\n{final}" if ctes else final


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"cast(round({expr}, {digits}) + 0.0 as double) as {name}"


def big(expr: str, name: str) -> str:
    return f"cast({expr} as bigint) as {name}"


def u(*parts: str) -> str:
    """Uniform of the md5 of its parts, as in functions.numeric.uniform."""
    text = "concat_ws('|', " + ", ".join(f"cast({p} as varchar)" for p in parts) + ")"
    return f"(cast(('0x' || substr(md5({text}), 1, 13)) as ubigint) / 4503599627370496.0)"


RTT = "((synack_ts - syn_ts) + 2.0 * ((ack_ts - synack_ts) / 2.0))"
VERSION = "case {u} % 4 when 0 then 'TLSv12' when 3 then 'unknown-64282' else 'TLSv13' end"

# ---- user events as flows
block("a_rn", (), """
select user_id, event_type, value, epoch_us(ts) / 1e6 as ts,
  row_number() over (partition by user_id order by ts, event_id) - 1 as rn from events""")
block("a_log", ("a_rn",), f"""
select 'user-' || user_id as conn_id,
  max(case when rn = 0 then ts end) as syn_ts, max(case when rn = 1 then ts end) as synack_ts, max(case when rn = 2 then ts end) as ack_ts,
  {VERSION.format(u='user_id')} as version,
  0 as client_hello, 1 as server_hello, 2 + user_id % 3 as ssl_est,
  greatest(count(*) - 3, 0) + case when user_id % 11 = 0 then 1 else 0 end as len
from a_rn group by user_id""")
block("a_pkt", ("a_rn",), """
select 'user-' || user_id as conn_id, rn - 3 as idx, ts,
  case when event_type in ('click', 'purchase', 'signup') then 1 else 0 end as direction, cast(1 + floor(value) as bigint) as size
from a_rn where rn >= 3""")
block("a_flow", ("a_log", "a_pkt"), f"""
select f.*, {RTT} as rtt from a_log f
left join (select conn_id, count(*) as n from a_pkt group by conn_id) c using (conn_id)
where f.len = coalesce(c.n, 0)""")
block("a_full", ("a_flow", "a_pkt"), "select p.*, f.rtt, f.ssl_est, f.len, f.version from a_pkt p join a_flow f using (conn_id)")
block("a_gap", ("a_full",), """
select conn_id, idx, direction as d, size as s, rtt,
  coalesce(ts - lag(ts) over (partition by conn_id, direction order by idx), 0.0) as raw,
  coalesce(ts - lag(ts) over (partition by conn_id, direction order by idx), 0.0) / case when rtt > 0 then rtt end as t
from a_full""")
block("a_strip", ("a_full",), """
select conn_id, idx - (ssl_est + 1) as idx, ts, direction, size, rtt from a_full where idx > ssl_est""")
block("a_prep", ("a_flow", "a_strip"), """
select conn_id, idx, direction as d, size as s,
  coalesce(ts - lag(ts) over (partition by conn_id, direction order by idx), 0.0) / case when rtt > 0 then rtt end as t
from a_strip""")

# ---- order lines as flows
block("b", (), """
select conn_id, side, idx, d, s, coalesce(ts - lag(ts) over (partition by conn_id, d order by idx), 0.0) / 86400.0 as t
from (
  select cast(l_orderkey as varchar) as conn_id, case when l_orderkey % 2 = 0 then 'P' else 'Q' end as side,
    row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as idx,
    epoch_us(l_shipdate) / 1e6 as ts, case when l_linestatus = 'O' then 1 else 0 end as d,
    cast(1 + floor(l_extendedprice / 72) as bigint) as s
  from lineitem)""")
block("b_n", ("b",), "select idx, count(*) as n from b group by idx")
block("b_freq", ("b",), "select idx, s as value, count(*) as freq from b where s between 1 and 1460 group by idx, s")
block("b_dense", ("b_n", "b_freq"), """
select p.idx, p.value, coalesce(f.freq, 0) as freq
from (select idx, unnest(range(1, 1461)) as value from b_n) p left join b_freq f on f.idx = p.idx and f.value = p.value""")
block("b_iqr", ("b_dense", "b_n"), """
select idx, coalesce(min(case when upto >= floor(n * 0.25) then value end), 1460) as q1,
  coalesce(min(case when upto >= floor(n * 0.75) then value end), 1460) as q3
from (select d.*, n, sum(freq) over (partition by d.idx order by value) as upto from b_dense d join b_n on b_n.idx = d.idx)
group by idx""")
block("b_q", ("b",), """
select idx, quantile_cont(t, 0.01) as q01, quantile_cont(t, 0.25) as q25, quantile_cont(t, 0.5) as q50,
  quantile_cont(t, 0.75) as q75, quantile_cont(t, 0.99) as q99 from b group by idx""")

# ---- conversations as flows
block("c", (), """
select conn_id, idx, d, s, coalesce(ts - lag(ts) over (partition by conn_id, d order by idx), 0.0) as t from (
  select cast(conv_id as varchar) as conn_id, turn as idx, cast(turn as double) as ts,
    case when role = 'user' then 1 else 0 end as d, cast(length(text) as bigint) as s from conversations)""")


def root(k: str, degree: str) -> str:
    guess = f"floor(pow({k}, 1.0 / ({degree})) + 0.5)"
    return f"case when pow({guess}, {degree}) <= {k} then {guess} else {guess} - 1 end"


def fit(order: int, eps: float = EPS, delta: float = DELTA, mask: tuple[str, ...] = ()) -> str:
    """Blocks of a quantizer fitted on the order lines; returns the suffix of their names.

    qz<x>(idx, n, k, root, budget, size_fd, size_bins, t_min, t_max, t_iqr, time_fd, time_bins, t_inv, tb, db, sb)
    lk<x>(idx, value, freq, bin) sizes to bins where sizes are binned
    """
    x = f"_{order}" + f"_{int(eps * 1000)}" + "".join(f"_{m[0]}" for m in mask)
    if f"qz{x}" in BLOCKS:
        return x
    time, way, size = ("timestamp" not in mask), ("direction" not in mask), ("size" not in mask)
    block(f"bad{x}", ("b_n",), f"select min(idx) as bad from b_n where n < (2.0 / ({eps}::double * {eps}::double)) * ln(2.0 / {delta}::double)")
    block(f"bud{x}", (f"bad{x}",), f"""
select idx, n, k, root, greatest(1, cast({'floor(root / 2)' if way else 'root'} as bigint)) as budget from (
  select *, case when least({order}, idx) + 1 = 1 then k else {root('k', f'(least({order}, idx) + 1)')} end as root from (
    select idx, n, cast(floor(n * ({eps}::double * {eps}::double)) as bigint) as k
    from b_n, bad{x} where bad is null or idx < bad))""")
    fd = "case when iqr = 0 then 1 else ceil(1460.0 / (2.0 * iqr * pow(n, -1.0 / 3.0))) end"
    if not size:
        bins = "1"
    elif not time:
        bins = "least(budget, 1460)"
    else:
        bins = f"least({fd}, least({root('budget', '2')}, 1460))"
    block(f"siz{x}", (f"bud{x}", "b_iqr"), f"""
select b.*, cast({fd} as bigint) as size_fd, cast(greatest(1, {bins}) as bigint) as size_bins
from bud{x} b join (select idx, q3 - q1 as iqr from b_iqr) using (idx)""")
    if time:
        tfd = "case when t_iqr = 0 or t_min = t_max then 1 else ceil((t_max - t_min) / (2.0 * t_iqr * pow(n, -1.0 / 3.0))) end"
        block(f"tim{x}", (f"siz{x}", "b_q"), f"""
select *, case when ln(1.0 + t_max) - ln(1.0 + t_min) > 0 then time_bins / (ln(1.0 + t_max) - ln(1.0 + t_min)) else 0.0 end as t_inv from (
  select *, greatest(1, least(time_fd, cast(floor(budget / size_bins) as bigint))) as time_bins from (
    select *, cast({tfd} as bigint) as time_fd from (
      select s.*, greatest(q01, 0.0) as t_min, q99 as t_max, q75 - q25 as t_iqr from siz{x} s join b_q using (idx))))""")
        tb = "greatest(1, cast(round((ln(1.0 + t_max) - ln(1.0 + t_min)) * t_inv) as bigint))"
    else:
        block(f"tim{x}", (f"siz{x}",), f"""
select *, null::bigint as time_fd, 1 as time_bins, 0.0 as t_min, 0.0 as t_max, null::double as t_iqr, 0.0 as t_inv from siz{x}""")
        tb = "1"
    block(f"qz{x}", (f"tim{x}",), f"select *, {tb} as tb, {2 if way else 1} as db, size_bins as sb from tim{x}")
    block(f"lk{x}", (f"siz{x}", "b_dense"), f"""
select idx, value, freq, sum(case when jump is not null and rank < size_bins then 1 else 0 end) over (partition by idx order by value) as bin from (
  select *, row_number() over (partition by idx order by jump desc nulls last, value) as rank from (
    select d.idx, d.value, d.freq, s.size_bins, abs(d.freq - lag(d.freq) over (partition by d.idx order by d.value)) as jump
    from b_dense d join siz{x} s on s.idx = d.idx where s.size_bins < 1460))""")
    return x


def time_bin(t: str) -> str:
    return (f"greatest(0, least(cast(floor((ln(1.0 + least(greatest({t}, t_min), t_max)) - ln(1.0 + t_min)) * t_inv) as bigint), tb - 1))")


def bin_text(b: str) -> str:
    return f"case when {b} < 0 then 'MASK' else cast({b} as varchar) end"


def sym_text(t: str, d: str, s: str) -> str:
    return f"'[t=' || {bin_text(t)} || ' d=' || {bin_text(d)} || ' s=' || {bin_text(s)} || ']'"


def grams(order: int, eps: float = EPS, delta: float = DELTA, mask: tuple[str, ...] = ()) -> str:
    """Blocks of n-grams and histograms on the order lines.

    sy<x>(conn_id, side, idx, st, sd, ss) gr<x>(conn_id, side, idx, ctx, sym, st, sd, ss)
    hi<x>(profile, idx, ctx, sym, cnt) me<x>(profile, idx, total, alphabet, len)
    """
    x = fit(order, eps, delta, mask)
    if f"gr{x}" in BLOCKS:
        return x
    time, way, size = ("timestamp" not in mask), ("direction" not in mask), ("size" not in mask)
    lags = "".join(f", lag(t, {j}) over w as t{j}, lag(d, {j}) over w as d{j}, lag(s, {j}) over w as s{j}" for j in range(1, order + 1))
    block(f"raw{x}", ("b",), f"select conn_id, side, idx, t as t0, d as d0, s as s0{lags} from b window w as (partition by conn_id order by idx)")
    joins, cols, texts = "", "", []
    for j in range(order + 1):
        joins += f" left join lk{x} l{j} on l{j}.idx = w.idx and l{j}.value = w.s{j}"
        tb = time_bin(f"t{j}") if time else "-1"
        tb = f"case when t{j} is not null then {tb} end"
        db = f"d{j}" if way else f"case when d{j} is not null then -1 end"
        sb = f"case when sb = 1460 then s{j} else l{j}.bin end" if size else f"case when s{j} is not null then -1 end"
        cols += f", {tb} as bt{j}, {db} as bd{j}, {sb} as bs{j}"
        if j:
            texts.insert(0, sym_text(f"bt{j}", f"bd{j}", f"bs{j}"))
    ctx = "'<' || concat_ws(', ', " + ", ".join(texts) + ") || '>'" if texts else "'<>'"
    block(f"cel{x}", (f"raw{x}", f"qz{x}", f"lk{x}"), f"""
select w.conn_id, w.side, w.idx, w.t0, w.d0, w.s0{cols} from raw{x} w join qz{x} q on q.idx = w.idx{joins}""")
    block(f"gr{x}", (f"cel{x}",), f"""
select conn_id, side, idx, {ctx} as ctx, {sym_text('bt0', 'bd0', 'bs0')} as sym, bt0 as st, bd0 as sd, bs0 as ss, t0, d0, s0 from cel{x}""")
    block(f"hi{x}", (f"gr{x}",), f"select side as profile, idx, ctx, sym, st, sd, ss, count(*) as cnt from gr{x} group by all")
    block(f"me{x}", (f"hi{x}", f"qz{x}"), f"""
select profile, h.idx, sum(cnt) as total, any_value(tb * db * sb) as alphabet, least({order}, h.idx) + 1 as len
from hi{x} h join qz{x} q on q.idx = h.idx group by profile, h.idx""")
    return x


def kl(order: int, p: str = "P", q: str = "Q", mask: tuple[str, ...] = (), eps: float = EPS) -> str:
    """Blocks kl<y>(idx, ctx, sym, contribution), de<y>(idx, delta), cu<y>(idx, cumulative)."""
    x = grams(order, eps, eps, mask)
    y = f"{x}_{p}{q}"
    if f"kl{y}" in BLOCKS:
        return y
    a = ALPHA
    block(f"kl{y}", (f"hi{x}", f"me{x}"), f"""
select p.idx, p.ctx, p.sym,
  case when p.idx < {order}
    then (p.cnt / mp.total) * ln((p.cnt / mp.total) / ((coalesce(q.cnt, 0) + {a}) / (mq.total + {a} * pow(mq.alphabet, mq.len))))
    else (p.cnt / mp.total) * ln((p.cnt / pp.n) / ((coalesce(q.cnt, 0) + {a}) / (coalesce(qq.n, 0) + mq.alphabet * {a}))) end as contribution
from (select * from hi{x} where profile = '{p}') p
left join (select * from hi{x} where profile = '{q}') q on q.idx = p.idx and q.ctx = p.ctx and q.sym = p.sym
join (select idx, ctx, sum(cnt)::double as n from hi{x} where profile = '{p}' group by idx, ctx) pp on pp.idx = p.idx and pp.ctx = p.ctx
left join (select idx, ctx, sum(cnt)::double as n from hi{x} where profile = '{q}' group by idx, ctx) qq on qq.idx = p.idx and qq.ctx = p.ctx
join (select idx, total::double as total from me{x} where profile = '{p}') mp on mp.idx = p.idx
join (select idx, total::double as total, alphabet::double as alphabet, len from me{x} where profile = '{q}') mq on mq.idx = p.idx""")
    block(f"de{y}", (f"kl{y}",), f"""
select idx, case when idx > 0 and idx < {order} then v - lag(v) over (order by idx) else v end as delta
from (select idx, sum(contribution) as v from kl{y} group by idx)""")
    block(f"cu{y}", (f"de{y}",), f"select idx, greatest(sum(delta) over (order by idx), 0.0) as cumulative from de{y}")
    return y


# ---- packet events
SEQ = "coalesce(sum(len) over (partition by user_id, is_orig order by rn rows between unbounded preceding and 1 preceding), 0)"
block("d_row", ("a_rn",), """
select user_id, rn, ts, case when rn >= 3 then cast(1 + floor(value) as bigint) else 0 end as len,
  case when rn > 3 then event_type in ('click', 'purchase', 'signup') else rn <> 1 end as is_orig from a_rn""")
block("d", ("d_row",), f"""
select 'user-' || user_id as conn_id, rn as arrival,
  case when user_id % 13 = 0 and rn = 30 then lag(ts) over (partition by user_id order by rn) - 3600.0 else ts end as ts,
  is_orig, len, {SEQ} + case when user_id % 7 = 0 and rn >= 20 then 1 else 0 end as seq,
  case when user_id % 19 = 0 and rn = 3 then '000000' when rn <= 5 then '160301' else '170303' end as head,
  case when rn = 3 then 'client_hello' when rn = 4 and user_id % 17 <> 0 then 'server_hello' when rn = 5 then 'ssl_est' end as event,
  {VERSION.format(u='user_id')} as version
from d_row""")
block("d_shake", ("d",), """
select conn_id, max(case when arrival = 0 then ts end) as syn_ts, max(case when arrival = 1 then ts end) as synack_ts,
  max(case when arrival = 2 then ts end) as ack_ts,
  min(case when event = 'client_hello' then arrival end) as ch, min(case when event = 'server_hello' then arrival end) as sh
from d group by conn_id""")
block("d_data", ("d", "d_shake"), """
select d.*, ch, sh, row_number() over (partition by d.conn_id order by arrival) - 1 as pos,
  lag(seq + len) over (partition by d.conn_id, is_orig order by arrival) as expected,
  lag(ts) over (partition by d.conn_id order by arrival) as before
from d join d_shake s on s.conn_id = d.conn_id
where len > 0 and arrival > 2 and synack_ts is not null and ack_ts is not null and syn_ts <= synack_ts and synack_ts <= ack_ts""")
block("d_judged", ("d_data",), """
select *, case
    when expected is not null and expected <> seq then 'unexpected sequence number'
    when pos = 0 and (not is_orig or head not in ('160300', '160301', '160302', '160303')) then 'missed TLS Client Hello'
    when pos > 0 and ts < before then 'saw data packets out-of-order'
    when pos > 0 and head = '170303' and (ch is null or ch >= arrival) then 'missed TLS Client Hello'
    when pos > 0 and head = '170303' and (sh is null or sh >= arrival) then 'missed TLS Server Hello' end as fault
from d_data where pos < 50""")
block("d_first", ("d_judged",), """
select conn_id, min(pos) as stop, arg_min(fault, pos) as reason, arg_min(arrival, pos) as stop_at,
  bool_or(pos = 0) as first from d_judged where fault is not null group by conn_id""")
block("d_taken", ("d_judged", "d_first"), """
select j.*, f.reason, f.stop_at from d_judged j left join d_first f using (conn_id)
where f.stop is null or j.pos < f.stop or (j.pos = f.stop and j.pos > 0 and j.fault like 'missed TLS%')""")
block("d_end", ("d_taken",), "select conn_id, count(*) as len, any_value(stop_at) as stop_at from d_taken group by conn_id")
block("d_mark", ("d_taken",), """
select conn_id, max(case when event = 'client_hello' then pos end) as client_hello,
  max(case when event = 'server_hello' then pos end) as server_hello,
  max(case when event = 'ssl_est' then pos end) as ssl_est, max(case when event = 'ssl_est' then version end) as version
from d_taken where (stop_at is null or arrival < stop_at) and pos < 49 group by conn_id""")


def assembled(shorter: bool) -> str:
    name = "d_flow" if shorter else "d_flow50"
    if name not in BLOCKS:
        block(name, ("d_end", "d_mark", "d_shake"), f"""
select s.conn_id, syn_ts, synack_ts, ack_ts, version, client_hello, server_hello, ssl_est, len
from d_end e join d_mark m using (conn_id) join d_shake s using (conn_id)
where client_hello is not null and server_hello is not null and ssl_est is not null and syn_ts <= synack_ts and synack_ts <= ack_ts
  and len - 1 > ssl_est and {'len > 0' if shorter else 'len = 50'}""")
    return name


def picks(order: int, mask: tuple[str, ...]) -> str:
    """Block pv<x>(idx, bin, value, lo, hi, total): running counts of the observed sizes of each bin."""
    x = fit(order, mask=mask)
    block(f"pv{x}", (f"lk{x}",), f"""
select idx, bin, value, hi - freq as lo, hi, total from (
  select *, sum(freq) over (partition by idx, bin order by value) as hi, sum(freq) over (partition by idx, bin) as total
  from lk{x} where freq > 0)""")
    return x


def cdfs(order: int, mask: tuple[str, ...], profile: str) -> str:
    """Blocks cd<k><x> for each context length k: running counts of symbols, contexts cut to their last k."""
    x = grams(order, mask=mask)
    for level in range(order + 1):
        ctx = "ctx" if level == order else "'<>'"
        block(f"cd{level}{x}", (f"hi{x}",), f"""
select idx, ctx, st, sd, ss, hi - cnt as lo, hi, total from (
  select *, sum(cnt) over (partition by idx, ctx order by st, sd, ss) as hi, sum(cnt) over (partition by idx, ctx) as total from (
    select idx, {ctx} as ctx, st, sd, ss, sum(cnt) as cnt from hi{x} where profile = '{profile}' group by all))""")
    return x


def chain(order: int, length: int, seed: int, flows: str, mask: tuple[str, ...], profile: str) -> str:
    """Blocks g0 .. of order-1 generation with time masked: (n, d, s, sym, level) per position."""
    assert order == 1 and mask == ("timestamp",)
    x = cdfs(order, mask, profile)
    picks(order, mask)
    for i in range(length):
        name = f"g{i}{x}"
        uu, uv = u(str(seed), "n", str(i)), u(str(seed), "n", str(i), "'size'")
        before = f"g{i - 1}{x}" if i else f"g_start{x}"
        if not i:
            block(before, (), f"select unnest(range(({flows}))) as n, null::bigint as d, null::bigint as s")
        past = sym_text("-1", "p.d", "coalesce(l.bin, p.s)") if i else "null"
        block(name, (before, f"lk{x}", f"cd1{x}", f"cd0{x}", f"pv{x}"), f"""
select n, sd as d, coalesce(v.value, ss) as s, {sym_text('-1', 'sd', 'ss')} as sym, level from (
  select p.n, coalesce(a.sd, b.sd) as sd, coalesce(a.ss, b.ss) as ss, {uv} as uv,
    case when a.sd is not null then {min(order, i)} else 0 end as level
  from (select p.n, {f"'<' || {past} || '>'" if i else "'<>'"} as ctx, {uu} as uu from {before} p
        left join lk{x} l on l.idx = {i} and l.value = p.s) p
  left join cd1{x} a on a.idx = {i} and a.ctx = p.ctx and uu * a.total >= a.lo and uu * a.total < a.hi
  left join cd0{x} b on b.idx = {i} and uu * b.total >= b.lo and uu * b.total < b.hi) c
left join pv{x} v on v.idx = {i} and v.bin = c.ss and uv * v.total >= v.lo and uv * v.total < v.hi""")
    return x


def wide(src: str, n: int, t: str | None, s: str | None, extra: str = "", where: str = "true") -> str:
    """Pivot of a feature block: one row per flow, -1 where it has ended."""
    cols = []
    for i in range(n):
        for name, expr in (("t", t), ("s", s)):
            if expr is not None:
                cols.append(f"cast(round(coalesce(max(case when idx = {i} then {expr} end), -1), 6) + 0.0 as double) as {name}_{i:03d}")
    return f"select conn_id{extra}, {', '.join(cols)} from {src} where {where} group by conn_id{extra.replace('cast(round(rtt, 6) as double) as rtt', 'rtt')} having count(*) filter (idx < {n}) > 0"


def wide_flows(src: str, n: int, t: str | None, s: str | None, rtt: bool = False, where: str = "true") -> str:
    """Pivot of a feature block, written from the flow table: also a flow without packets has a row, all -1."""
    cols = ["cast(round(any_value(f.rtt), 6) as double) as rtt"] if rtt else []
    for i in range(n):
        for name, expr in (("t", t), ("s", s)):
            if expr is not None:
                cols.append(f"cast(round(coalesce(max(case when g.idx = {i} then {expr} end), -1), 6) + 0.0 as double) as {name}_{i:03d}")
    usable = "f.rtt > 0 and " if t == "t" else ""
    return f"select f.conn_id, {', '.join(cols)} from a_flow f left join {src} g on g.conn_id = f.conn_id where {usable}({where}) group by f.conn_id"

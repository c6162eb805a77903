"""Shared common table expressions for the reference SQL of every registered query."""

from __future__ import annotations

# name -> (names it reads, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, reads: str, body: str) -> None:
    CTES[name] = (tuple(reads.split()), body)


def sql(reads: str, body: str) -> str:
    """Prefix `body` with the expressions it reads, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in reads.split():
        visit(name)
    if not ordered:
        return body
    body = body.strip()
    joint = "" if body.startswith(",") else "\n"
    head = ",\n".join(f"{n} AS (\n{CTES[n][1].strip()}\n)" for n in ordered)
    return f"WITH {head}{joint}{body}"


def weekdays_to(day: str) -> str:
    """Weekdays from Monday 1900-01-01 up to a day, that day left out; differences count any span."""
    n = f"({day} - DATE '1900-01-01')"
    return f"({n} // 7 * 5 + least({n} % 7, 5))"


cte("yrs", "", "SELECT CAST(range AS BIGINT) AS y FROM range(1989, 2006)")
cte("hol", "yrs", """
SELECT CASE isodow(f) WHEN 6 THEN f - 1 WHEN 7 THEN f + 1 ELSE f END AS h
FROM (SELECT make_date(y, m, d) AS f FROM yrs, (VALUES (1, 1), (7, 4), (11, 11), (12, 25)) t(m, d)) q
UNION
SELECT f + CAST((8 - isodow(f)) % 7 + 7 * (n - 1) AS INTEGER)
FROM (SELECT make_date(y, m, 1) AS f, n FROM yrs, (VALUES (1, 3), (2, 3), (9, 1), (10, 2)) t(m, n)) q
UNION
SELECT f + CAST((11 - isodow(f)) % 7 + 21 AS INTEGER) FROM (SELECT make_date(y, 11, 1) AS f FROM yrs) q
UNION
SELECT f - CAST((isodow(f) + 5) % 7 + 1 AS INTEGER) FROM (SELECT make_date(y, 6, 1) AS f FROM yrs) q
""")
cte("cal", "hol", """
SELECT day, is_h, is_bd,
  min(CASE WHEN is_bd THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nbd,
  max(CASE WHEN is_bd THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pbd
FROM (SELECT day, h IS NOT NULL AS is_h, isodow(day) < 6 AND h IS NULL AS is_bd
      FROM (SELECT CAST(range AS DATE) AS day FROM range(DATE '1989-12-01', DATE '2005-02-01', INTERVAL 1 DAY)) d
      LEFT JOIN hol ON h = day) q
""")
cte("ev", "", """
SELECT o_orderkey AS event_key, o_custkey AS entity_id, o_orderpriority AS segment, o_orderstatus = 'F' AS is_repeat,
  CAST(o_orderdate AS DATE) AS announce_date,
  CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 7 AS INTEGER) AS event_date, o_totalprice AS amount
FROM orders
""")
cte("evc", "ev cal", """
SELECT ev.*, announce_date AS announcement_cutoff, pbd AS pre_event_cutoff, nbd AS result_safe_date
FROM ev LEFT JOIN cal ON day = event_date
""")
cte("res", "", """
SELECT l_orderkey AS event_key,
  round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END), 2) AS primary_accepted,
  round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END), 2) AS direct_accepted,
  round(sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_extendedprice ELSE 0 END), 2) AS indirect_accepted,
  round(sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber % 2 = 0
                 THEN l_extendedprice ELSE 0 END), 2) AS noncomp_accepted,
  round(sum(CASE WHEN l_returnflag = 'R' AND NOT (l_linestatus = 'O' OR (l_linestatus = 'F' AND l_linenumber % 2 = 0))
                 THEN l_extendedprice ELSE 0 END), 2) AS foreign_accepted,
  round(sum(l_extendedprice) * 2, 2) AS tendered
FROM lineitem GROUP BY 1
""")
cte("outc", "evc res", """
SELECT *, primary_accepted / nullif(public_total, 0) AS primary_share,
  direct_accepted / nullif(public_total, 0) AS direct_share, indirect_accepted / nullif(public_total, 0) AS indirect_share,
  noncomp_accepted / nullif(public_total, 0) AS noncomp_share, foreign_accepted / nullif(public_total, 0) AS foreign_share,
  public_total IS NOT NULL AS results_available
FROM (SELECT evc.*, res.* EXCLUDE (event_key),
        round(primary_accepted + direct_accepted + indirect_accepted + noncomp_accepted + foreign_accepted, 2) AS public_total
      FROM evc LEFT JOIN res USING (event_key)) q
""")
cte("pool", "outc", """
SELECT event_key, entity_id, segment, is_repeat, announce_date, event_date, CAST(year(event_date) AS INTEGER) AS event_year,
  announcement_cutoff, pre_event_cutoff, result_safe_date, amount, primary_share FROM outc
""")
cte("wk", "", """
SELECT l_returnflag AS series, CAST(date_trunc('week', l_shipdate) AS DATE) + 2 AS observed,
  round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2
""")
cte("wkrel", "wk cal", """
SELECT w.*, published_date, n.nbd AS safe_date FROM (
  SELECT observed, max(CASE WHEN series = 'A' THEN value END) AS value_A,
    max(CASE WHEN series = 'N' THEN value END) AS value_N, max(CASE WHEN series = 'R' THEN value END) AS value_R
  FROM wk GROUP BY 1) w
JOIN (SELECT day - 1 AS observed, CASE WHEN is_h THEN nbd ELSE day END AS published_date FROM cal) p USING (observed)
JOIN cal n ON n.day = published_date
""")
cte("dy", "", """
SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS observed, round(sum(l_extendedprice) / 1000000, 8) AS value
FROM lineitem GROUP BY 1, 2
""")
cte("ct", "", """
SELECT CAST(l_suppkey % 6 AS INTEGER) AS contract, CAST(date_trunc('week', l_shipdate) AS DATE) + 1 AS observed,
  sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS long_qty,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS short_qty, sum(l_quantity) AS open_interest
FROM lineitem GROUP BY 1, 2
""")
cte("vint", "", """
SELECT vintage, observed, round(sum(added), 2) AS value FROM (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS booked, CAST(date_trunc('month', l_shipdate) AS DATE) AS observed,
    sum(l_extendedprice) AS added FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) c
JOIN (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS vintage FROM orders) v
  ON booked <= vintage AND observed <= vintage GROUP BY 1, 2
""")

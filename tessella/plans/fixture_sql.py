"""The response fixtures as SQL for an independent engine, to hold the queries against."""

from __future__ import annotations

ORDER = "l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_shipdate DESC"


def responses(name: str = "resp", target: bool = False) -> str:
    """One row per model and item: l1..l3, h1..h3, gold."""
    where = "WHERE l_shipdate >= TIMESTAMP '1995-06-01'" if target else ""
    signal = lambda k: f"CASE WHEN gold = {k} THEN 4.0::DOUBLE * (0.5::DOUBLE + ((l_suppkey * 13) % 17) / 17.0::DOUBLE) * (0.15::DOUBLE - (((item * 37) % 101) / 101.0::DOUBLE - 0.5::DOUBLE)) * h{k + 1} ELSE 0.0::DOUBLE END"
    return f"""{name}_li AS (
        SELECT *, l_partkey % 400 AS item, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 400 ORDER BY {ORDER}) AS rn FROM lineitem {where}),
    {name}_b AS (
        SELECT l_suppkey, item, s_nationkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS gold,
            (1 + l_linenumber % 3)::DOUBLE AS h1, 2.0::DOUBLE AS h2, 3.0::DOUBLE AS h3,
            -l_quantity / 10.0::DOUBLE AS b1, -20.0::DOUBLE * l_tax - 1.0::DOUBLE AS b2, -20.0::DOUBLE * l_discount - 1.0::DOUBLE AS b3
        FROM {name}_li JOIN supplier ON l_suppkey = s_suppkey WHERE rn = 1),
    {name} AS (
        SELECT l_suppkey::VARCHAR AS model_id, s_nationkey::VARCHAR AS org_id, item::VARCHAR AS item_id, gold, h1, h2, h3,
            b1 + {signal(0)} AS l1, b2 + {signal(1)} AS l2, b3 + {signal(2)} AS l3
        FROM {name}_b)"""


def observations(name: str = "obs", source: str = "resp") -> str:
    """What the projection of a response gives, with plain scalar columns."""
    return f"""{name}_u AS (
        SELECT *, l1 / h1 AS u1, l2 / h2 AS u2, l3 / h3 AS u3 FROM {source}),
    {name}_t AS (
        SELECT *, greatest(u1, u2, u3) AS t, CASE gold WHEN 0 THEN u1 WHEN 1 THEN u2 ELSE u3 END AS ug,
            CASE gold WHEN 0 THEN u2 ELSE u1 END AS o1, CASE gold WHEN 2 THEN u2 ELSE u3 END AS o2 FROM {name}_u),
    {name}_w AS (
        SELECT *, CASE WHEN u1 = t THEN 0 WHEN u2 = t THEN 1 ELSE 2 END AS win, exp(u1 - t) + exp(u2 - t) + exp(u3 - t) AS s FROM {name}_t),
    {name}_p AS (
        SELECT *, exp(u1 - t) / s AS p1, exp(u2 - t) / s AS p2, exp(u3 - t) / s AS p3,
            CASE win WHEN 0 THEN u2 ELSE u1 END AS n1, CASE win WHEN 2 THEN u2 ELSE u3 END AS n2 FROM {name}_w),
    {name}_q AS (
        SELECT *, exp(n1 - greatest(n1, n2)) / (exp(n1 - greatest(n1, n2)) + exp(n2 - greatest(n1, n2))) AS q1,
            exp(n2 - greatest(n1, n2)) / (exp(n1 - greatest(n1, n2)) + exp(n2 - greatest(n1, n2))) AS q2 FROM {name}_p),
    {name} AS (
        SELECT model_id, org_id, item_id,
            ug - (greatest(o1, o2) + ln(exp(o1 - greatest(o1, o2)) + exp(o2 - greatest(o1, o2)))) AS ell,
            greatest(p1, p2, p3) AS c, win = gold AS y, CASE WHEN win = gold THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS e,
            t - ug AS z, t + ln(s) - ug AS nll,
            ((CASE WHEN u1 > ug OR (u1 = ug AND 0 < gold) THEN 1 ELSE 0 END) + (CASE WHEN u2 > ug OR (u2 = ug AND 1 < gold) THEN 1 ELSE 0 END) + (CASE WHEN u3 > ug OR (u3 = ug AND 2 < gold) THEN 1 ELSE 0 END)) / 2.0::DOUBLE AS depth,
            ((CASE WHEN q1 > 0 THEN -q1 * ln(q1) ELSE 0 END) + (CASE WHEN q2 > 0 THEN -q2 * ln(q2) ELSE 0 END)) / ln(2.0::DOUBLE) AS hn,
            pow(p1 - (gold = 0)::INT, 2) + pow(p2 - (gold = 1)::INT, 2) + pow(p3 - (gold = 2)::INT, 2) AS brier,
            ((CASE WHEN p1 > 0 THEN -p1 * ln(p1) ELSE 0 END) + (CASE WHEN p2 > 0 THEN -p2 * ln(p2) ELSE 0 END) + (CASE WHEN p3 > 0 THEN -p3 * ln(p3) ELSE 0 END)) / ln(3.0::DOUBLE) AS h,
            greatest(p1, p2, p3) - (p1 + p2 + p3 - greatest(p1, p2, p3) - least(p1, p2, p3)) AS margin
        FROM {name}_q)"""


HALVES = "halves AS (SELECT item_id, (row_number() OVER (ORDER BY sha256('20260914|' || item_id), item_id) - 1) % 2 AS half FROM (SELECT DISTINCT item_id FROM obs))"


def with_obs(body: str, *more: str) -> str:
    """A statement over ``resp`` and ``obs``; ``more``: further common tables."""
    return "WITH " + ",\n".join([responses(), observations(), *more]) + "\n" + body

"""Queries on vector tiles. The lines of ``plans.lines`` lie on a map of 120 km, rank by rank from deeper zooms on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import tiles as op
from .lines import POINTS, lines

#: Width of the map in metres, and its zooms.
WIDTH, LOW, HIGH = 120_000.0, 2, 5
#: A vertex's distance from the chord of its stretch, squared as the tiles' simplifying does it.
FAR = """sqrt((v.x - f.x - u * (g.x - f.x)) ** 2 + (v.y - f.y - u * (g.y - f.y)) ** 2)"""


def _share(axis: str) -> tuple[str, str]:
    low, high = f"((-64 - {axis}) / nullif(d{axis}, 0))", f"((4160 - {axis}) / nullif(d{axis}, 0))"
    return (
        f"case when d{axis} <> 0 then least({low}, {high}) when {axis} between -64 and 4160 then 0 else 2 end",
        f"case when d{axis} <> 0 then greatest({low}, {high}) else 1 end",
    )


@query(f"""
with recursive p as materialized (select id, z as zoom, row_number() over (partition by id, z order by case when id % 2 = 1 then -n else n end) - 1 as n,
    x / {WIDTH} * (4096 << z) as x, y / {WIDTH} * (4096 << z) as y from ({POINTS}), range({LOW}, {HIGH + 1}) t(z) where z >= {LOW} + id % 3),
r(id, zoom, a, b) as (select id, zoom, 0, max(n) from p group by 1, 2
    union all select id, zoom, unnest([a, m]), unnest([m, b]) from (
        select id, zoom, a, b, min(n) filter (far = top) as m, any_value(top) as top from (
            select *, max(far) over (partition by id, zoom, a, b) as top from (
                select r.id, r.zoom, r.a, r.b, v.n, {FAR} as far from r
                join p f on f.id = r.id and f.zoom = r.zoom and f.n = r.a join p g on g.id = r.id and g.zoom = r.zoom and g.n = r.b
                join p v on v.id = r.id and v.zoom = r.zoom and v.n > r.a and v.n < r.b,
                lateral (select case when (g.x - f.x) ** 2 + (g.y - f.y) ** 2 > 0 then greatest(0, least(1, ((v.x - f.x) * (g.x - f.x) + (v.y - f.y) * (g.y - f.y)) / ((g.x - f.x) ** 2 + (g.y - f.y) ** 2))) else 0 end as u) l)) group by 1, 2, 3, 4) where top > 4),
k as (select distinct id, zoom, unnest([a, b]) as n from r),
w as (select id, zoom, n, round_even(x, 0)::bigint as x, round_even(y, 0)::bigint as y from p join k using (id, zoom, n)),
s as (select id, zoom, n, x, y, lead(x) over o - x as dx, lead(y) over o - y as dy from w window o as (partition by id, zoom order by n)),
t as (select id, zoom, n, tx, ty, (x - tx * 4096)::double as x, (y - ty * 4096)::double as y, dx, dy from s, range(0, 32) a(tx), range(0, 32) b(ty)
    where (dx <> 0 or dy <> 0) and greatest(tx, ty) < 1 << zoom and tx * 4096 - 64 <= greatest(x, x + dx) and tx * 4096 + 4160 >= least(x, x + dx) and ty * 4096 - 64 <= greatest(y, y + dy) and ty * 4096 + 4160 >= least(y, y + dy)),
c as (select *, greatest(0, {_share("x")[0]}, {_share("y")[0]}) as i, least(1, {_share("x")[1]}, {_share("y")[1]}) as o from t),
e as (select id, zoom, tx, ty, n, round_even(x + i * dx, 0)::bigint as ax, round_even(y + i * dy, 0)::bigint as ay, round_even(x + o * dx, 0)::bigint as qx, round_even(y + o * dy, 0)::bigint as qy from c where i <= o),
g as (select *, coalesce(lag(qx) over q <> ax or lag(qy) over q <> ay, true) as new from e window q as (partition by id, zoom, tx, ty order by n)),
h as (select *, sum(new::int) over (partition by id, zoom, tx, ty order by n) as part from g),
v as (select id, zoom, tx, ty, part, n, 0 as k, ax as x, ay as y from h where new union all select id, zoom, tx, ty, part, n, 1, qx, qy from h where ax <> qx or ay <> qy),
u as (select *, row_number() over (partition by id, zoom, tx, ty, part order by n, k) - 1 as nth, count(*) over (partition by id, zoom, tx, ty, part) as every from v)
select zoom::int as zoom, tx, ty, id, part::bigint as part, nth::int as n, x, y from u where every > 1
""")
def tiled_lines(spark, d):
    """The runs of lines in the tiles of four zooms."""
    return op.runs(op.at_zooms(_mapped(spark, d), LOW, HIGH))


@query()
def vector_tiles(spark, d):
    """The same lines as coded tiles."""
    return op.coded(op.runs(op.at_zooms(_mapped(spark, d), LOW, HIGH)), "lines")


def _mapped(spark, d):
    shrunk = F.transform("points", lambda p: F.struct((p["x"] / WIDTH).alias("x"), (p["y"] / WIDTH).alias("y")))
    return lines(spark, d).select("id", (F.lit(LOW) + F.col("id") % 3).alias("from_zoom"), shrunk.alias("points"))

"""SQL (DuckDB) that gives the same rows as the terrain queries, built from common table expressions."""

from __future__ import annotations

import re

_DEM = """
dim AS (SELECT CAST(floor(sqrt(count(*) / 6.0)) AS BIGINT) AS n FROM lineitem),
raw AS (SELECT l_orderkey % n + 1 AS i, l_partkey % n + 1 AS j, sum(CAST(round(l_quantity) AS BIGINT)) AS s FROM lineitem CROSS JOIN dim GROUP BY 1, 2),
ax AS (SELECT CAST(k AS BIGINT) AS k FROM dim, unnest(range(1, n + 1)) AS u(k)),
dense AS (SELECT a.k AS i, b.k AS j, coalesce(raw.s, 0) AS s FROM ax a CROSS JOIN ax b LEFT JOIN raw ON raw.i = a.k AND raw.j = b.k),
off AS (SELECT * FROM (VALUES (-2), (-1), (0), (1), (2)) AS v(d)),
sm AS (SELECT d.i + x.d AS i, d.j + y.d AS j, d.s FROM dense d CROSS JOIN off x CROSS JOIN off y),
dem AS (SELECT i + (j - 1) * n AS cell_id, i, j, CAST((CAST(sum(s) AS BIGINT) * 1000) // count(*) AS DOUBLE) AS z
        FROM sm CROSS JOIN dim WHERE i BETWEEN 1 AND n AND j BETWEEN 1 AND n GROUP BY i, j, n)"""

_EDIT = """,
dom AS (SELECT n // 3 AS a, n // 2 AS b FROM dim),
dem2 AS (SELECT c.cell_id, c.i, c.j, coalesce(t.z, c.z) AS z FROM dem c CROSS JOIN dom
         LEFT JOIN dem t ON t.i = c.j AND t.j = c.i AND c.i BETWEEN dom.a AND dom.b AND c.j BETWEEN dom.a AND dom.b)"""

_SHIFT = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, 1), (1, -1), (-1, 1))
_PAIR = (1, 0, 3, 2, 5, 4, 7, 6)


def _field(dem: str = "dem", diagonals: bool = True, masked: bool = False, own: str = "", more: str = "", steps: tuple[str, str, str] = ("1.0::DOUBLE", "1.0::DOUBLE", "(1 / sqrt(2.0::DOUBLE))")) -> str:
    """CTEs ending in fld(cell_id, i, j, z, dir, slope). own: condition for buildings; more: columns that steps use; steps: slopes for a unit of height along i, j and both."""
    n = 8 if diagonals else 4
    build = "(i * 31 + j * 17) % 101 = 0" if masked else own or "false"
    sink = "(i * 13 + j * 29) % 211 = 0" if masked else "false"
    joins = " ".join(f"LEFT JOIN hz n{k} ON n{k}.i = c.i + {_SHIFT[k][0]} AND n{k}.j = c.j + {_SHIFT[k][1]}" for k in range(n))
    raw = ", ".join(f"(n{k}.z - c.z) * {steps[k // 2] if k < 4 else steps[2]} AS r{k}" for k in range(n))
    full = [f"coalesce(r{k}, -r{_PAIR[k]}) AS s{k}" if k < 6 else f"CASE WHEN coalesce(r4, -r5) IS NOT NULL THEN coalesce(r{k}, -r{_PAIR[k]}) END AS s{k}" for k in range(n)]
    least = "least(" + ", ".join(f"s{k}" for k in range(n)) + ")"
    pick = "CASE " + " ".join(f"WHEN s{k} = best THEN {k}" for k in range(n)) + " END"
    return f""",
hz AS (SELECT cell_id, i, j, z AS h{more}, CASE WHEN {build} THEN 'Infinity'::DOUBLE ELSE z END AS z FROM {dem}),
nb AS (SELECT c.cell_id, c.i, c.j, c.h AS z, {raw} FROM hz c {joins}),
sl AS (SELECT cell_id, i, j, z, {", ".join(full)} FROM nb),
bs AS (SELECT *, {least} AS best FROM sl),
fld AS (SELECT cell_id, i, j, z, CASE WHEN {sink} THEN -3 WHEN {build} THEN -2 WHEN z IS NULL THEN NULL WHEN best < 0 THEN {pick} ELSE -1 END AS dir,
        CASE WHEN {sink} OR {build} THEN NULL ELSE best END AS slope FROM bs)"""


_EXIT = "((i = 1 AND dir IN (-1, 0, 4, 7)) OR (i = n AND dir IN (-1, 1, 5, 6)) OR (j = 1 AND dir IN (-1, 2, 4, 6)) OR (j = n AND dir IN (-1, 3, 5, 7)) OR dir = -3)"
_TO_I = "i + CASE WHEN dir IN (0, 4, 7) THEN -1 WHEN dir IN (1, 5, 6) THEN 1 ELSE 0 END"
_TO_J = "j + CASE WHEN dir IN (2, 4, 6) THEN -1 WHEN dir IN (3, 5, 7) THEN 1 ELSE 0 END"
_PTR = f""",
ptr AS (SELECT cell_id, i, j, z, dir, CASE WHEN dir = -2 THEN NULL WHEN dir >= 0 AND {_TO_I} BETWEEN 1 AND n AND {_TO_J} BETWEEN 1 AND n
        THEN {_TO_I} + ({_TO_J} - 1) * n ELSE cell_id END AS target, {_EXIT} AS leaves FROM fld CROSS JOIN dim)"""

_FLAT = """,
fe AS (SELECT a.cell_id, b.cell_id AS neighbour FROM fld a JOIN fld b ON a.dir = -1 AND b.dir = -1
       AND ((b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1) OR (b.i = a.i + 1 AND b.j = a.j + 1) OR (b.i = a.i - 1 AND b.j = a.j + 1)))"""

_REGIONS = (
    _PTR
    + _FLAT
    + """,
fs AS (SELECT cell_id AS u, neighbour AS v FROM fe UNION SELECT neighbour, cell_id FROM fe),
freach(u, v) AS (SELECT u, u FROM fs UNION SELECT r.u, fs.v FROM freach r JOIN fs ON fs.u = r.v),
froot AS (SELECT u AS cell_id, min(v) AS root FROM freach GROUP BY u),
walk(cell_id, cur) AS (SELECT cell_id, cell_id FROM ptr WHERE target IS NOT NULL UNION ALL
  SELECT w.cell_id, p.target FROM walk w JOIN ptr p ON p.cell_id = w.cur WHERE p.target <> w.cur),
ends AS (SELECT w.cell_id, coalesce(f.root, w.cur) AS comp FROM walk w JOIN ptr p ON p.cell_id = w.cur AND p.target = w.cur LEFT JOIN froot f ON f.cell_id = w.cur),
comps AS (SELECT comp, min(e.cell_id) AS first_cell, bool_or(p.leaves) AS outside FROM ends e JOIN ptr p USING (cell_id) GROUP BY comp),
nums AS (SELECT comp, CASE WHEN outside THEN -row_number() OVER (PARTITION BY outside ORDER BY first_cell) ELSE row_number() OVER (PARTITION BY outside ORDER BY first_cell) END AS region FROM comps),
rg AS (SELECT p.cell_id, p.i, p.j, p.z, p.dir, coalesce(n.region, 0) AS region FROM ptr p LEFT JOIN ends e USING (cell_id) LEFT JOIN nums n USING (comp))"""
)

_ORD = (0, 0, 1, 1, 2, 2, 3, 3)
_FIRST = (True, False, True, False, True, False, False, True)
_PASSES = " UNION ALL ".join(
    f"SELECT a.region AS src, b.region AS dst, greatest(a.z, b.z) AS z_pass, 0 AS phase, {_ORD[k]} AS ord, {'b' if _FIRST[k] else 'a'}.cell_id AS pos, a.cell_id AS cell, b.cell_id AS ncell "
    f"FROM rg a JOIN rg b ON b.i = a.i + {_SHIFT[k][0]} AND b.j = a.j + {_SHIFT[k][1]} WHERE a.region > 0 AND b.region <> 0 AND a.region <> b.region"
    for k in range(8)
)
_SPILL = f""",
ps0 AS ({_PASSES} UNION ALL
  SELECT region, 0, z, 1, CASE WHEN j IN (1, n) THEN 2 * i + CASE WHEN j = 1 THEN 0 ELSE 1 END ELSE 2 * n + 2 * j + CASE WHEN i = 1 THEN 0 ELSE 1 END END, cell_id, cell_id, cell_id
  FROM rg CROSS JOIN dim WHERE region > 0 AND (i IN (1, n) OR j IN (1, n))),
rag AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY z_pass, phase, ord, pos, cell, ncell) AS rn FROM ps0) WHERE rn = 1)"""

_TRAPS = (
    _SPILL
    + """,
ord AS (SELECT src AS a, dst AS b, z_pass, cell, ncell, row_number() OVER (ORDER BY z_pass, phase, ord, pos, src) AS k FROM rag WHERE dst <= 0 OR src < dst),
regs AS (SELECT DISTINCT region FROM rg WHERE region > 0),
st(k, region, comp, drained) AS (
  SELECT CAST(0 AS BIGINT), region, region, false FROM regs
  UNION ALL
  SELECT k + 1, region,
    CASE WHEN b > 0 AND ca <> cb AND NOT da AND NOT db AND comp IN (ca, cb) THEN least(ca, cb) ELSE comp END,
    drained OR (b <= 0 AND comp = ca) OR (b > 0 AND ca <> cb AND da <> db AND comp = CASE WHEN da THEN cb ELSE ca END)
  FROM (SELECT s.k, s.region, s.comp, s.drained, o.b,
          max(CASE WHEN s.region = o.a THEN s.comp END) OVER () AS ca, max(CASE WHEN s.region = o.b THEN s.comp END) OVER () AS cb,
          bool_or(s.region = o.a AND s.drained) OVER () AS da, bool_or(s.region = o.b AND s.drained) OVER () AS db
        FROM st s JOIN ord o ON o.k = s.k + 1)),
dies AS (
  SELECT a.k, a.comp, o.z_pass AS elevation FROM st a JOIN st b ON b.k = a.k + 1 AND b.region = a.region JOIN ord o ON o.k = b.k
  JOIN (SELECT k, comp, count(*) AS size FROM st GROUP BY 1, 2) x ON x.k = a.k AND x.comp = a.comp
  JOIN (SELECT k, comp, count(*) AS size FROM st GROUP BY 1, 2) y ON y.k = b.k AND y.comp = b.comp
  WHERE NOT a.drained AND (b.drained OR x.size <> y.size) GROUP BY ALL),
mem AS (SELECT d.k, d.comp, d.elevation, s.region FROM dies d JOIN st s ON s.k = d.k AND s.comp = d.comp),
tr AS (SELECT k, comp, elevation, min(region) AS min_region, count(*) AS n_regions FROM mem GROUP BY ALL),
vol AS (SELECT m.k, m.comp, sum(greatest(m.elevation - c.z, 0)) AS volume, count(*) FILTER (c.z <= m.elevation) AS n_cells FROM mem m JOIN rg c ON c.region = m.region GROUP BY ALL),
par AS (SELECT k, comp, pk, pcomp FROM (
    SELECT t.k, t.comp, p.k AS pk, p.comp AS pcomp, row_number() OVER (PARTITION BY t.k, t.comp ORDER BY p.n_regions) AS rn
    FROM tr t JOIN mem m ON m.region = t.min_region JOIN tr p ON p.k = m.k AND p.comp = m.comp AND p.n_regions > t.n_regions) WHERE rn = 1),
sub AS (SELECT p.pk AS k, p.pcomp AS comp, sum(v.volume) AS subvolume FROM par p JOIN vol v ON v.k = p.k AND v.comp = p.comp GROUP BY ALL)"""
)


def _sql(parts: str, select: str) -> str:
    return "WITH RECURSIVE" + _DEM + parts + "\n" + select


_REG = _field() + _REGIONS
_ALL = _REG + _TRAPS
_EDITED = _EDIT + _field("dem2")
_MASKED = _field(masked=True) + _REGIONS + _TRAPS
_DIRS = "SELECT cell_id, CAST(dir AS TINYINT) AS dir, slope FROM fld"
_EVENTS = "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> (SELECT min(event_type) FROM events) THEN value END AS value FROM events) "
_MASK = """, mk AS (SELECT cell_id, i, j, z FROM dem WHERE z >= 160000),
ml AS (SELECT a.cell_id AS u, b.cell_id AS v FROM mk a CROSS JOIN dim JOIN mk b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1) WHERE a.i < n AND a.j < n),
ms AS (SELECT u, v FROM ml UNION SELECT v, u FROM ml),
mr(u, v) AS (SELECT cell_id, cell_id FROM mk UNION SELECT r.u, ms.v FROM mr r JOIN ms ON ms.u = r.v),
cl AS (SELECT u AS cell_id, min(v) AS cluster FROM mr GROUP BY u)"""
_DOWN = """,
dn AS (SELECT t.*, o.z_pass AS pass, CASE WHEN x.ina THEN o.b ELSE o.a END AS down, CASE WHEN x.ina THEN o.cell ELSE o.ncell END AS cur_cell, CASE WHEN x.ina THEN o.ncell ELSE o.cell END AS down_cell
  FROM tr t JOIN ord o ON o.k = t.k + 1 JOIN LATERAL (SELECT count(*) > 0 AS ina FROM mem m WHERE m.k = t.k AND m.comp = t.comp AND m.region = o.a) x ON true),
sg AS (SELECT d.k, d.comp, d.min_region, d.n_regions, CASE WHEN p.pk IS NULL AND d.down <= 0 THEN d.down END AS away, coalesce(p.pk, l.k) AS tk, coalesce(p.pcomp, l.comp) AS tcomp
  FROM dn d LEFT JOIN par p USING (k, comp) LEFT JOIN tr l ON l.min_region = d.down AND l.n_regions = 1)"""


def _complete(name: str, n: int) -> str:
    """CTE of the spill graph of the traps without a region divisible by n: k, comp, to_region, to_regions."""
    return f""",
f{n} AS (SELECT k, comp, bool_and(region % {n} <> 0) AS is_full FROM mem GROUP BY ALL),
r{n} AS (SELECT p.pk AS k, p.pcomp AS comp, bool_and(f.is_full) AS ok FROM par p JOIN f{n} f USING (k, comp) GROUP BY ALL),
{name} AS (SELECT d.k, d.comp, CASE WHEN r.ok OR pf.is_full THEN q.min_region WHEN d.down > 0 THEN d.down ELSE -1 END AS to_region, CASE WHEN r.ok OR pf.is_full THEN q.n_regions WHEN d.down > 0 THEN 1 ELSE 0 END AS to_regions
  FROM dn d JOIN f{n} f USING (k, comp) LEFT JOIN par p USING (k, comp) LEFT JOIN r{n} r ON r.k = p.pk AND r.comp = p.pcomp LEFT JOIN f{n} pf ON pf.k = p.pk AND pf.comp = p.pcomp
  LEFT JOIN tr q ON q.k = p.pk AND q.comp = p.pcomp WHERE f.is_full)"""


_TOP = """,
top AS (SELECT t.k, t.comp, t.elevation FROM tr t ANTI JOIN par USING (k, comp)),
tmem AS (SELECT m.region, t.elevation, t.k, t.comp FROM top t JOIN mem m USING (k, comp))"""


def _above(goals: str) -> str:
    """CTE of the lowest traps whose water reaches one of the goals (k, comp) once all are full."""
    return f""",
up(k, comp) AS ({goals} UNION SELECT s.k, s.comp FROM up u JOIN sg s ON s.tk = u.k AND s.tcomp = u.comp),
upr AS (SELECT t.min_region AS region FROM up JOIN tr t USING (k, comp) WHERE t.n_regions = 1)"""


def _upstream(cell: str) -> str:
    """Rows of the area upstream of a cell, everything that spills into it included."""
    return _sql(
        _ALL + _DOWN + _TOP + f""", here AS ({cell}), spot AS (SELECT c.cell_id, c.region, t.k, t.comp, c.z <= t.elevation AS pond FROM rg c JOIN here USING (cell_id) JOIN tmem t ON t.region = c.region),
area AS (SELECT DISTINCT w.cell_id FROM walk w JOIN spot ON spot.cell_id = w.cur WHERE NOT spot.pond)"""
        + _above("SELECT k, comp FROM (SELECT k, comp FROM spot WHERE pond UNION SELECT t.k, t.comp FROM top t JOIN dn d USING (k, comp) JOIN area a ON a.cell_id = d.down_cell)"),
        "SELECT cell_id FROM area UNION SELECT c.cell_id FROM rg c JOIN upr USING (region)",
    )


#: Rain 2 and infiltration (i + j) mod 3 through a graph of cells and (negative) full lowest traps, in the
#: order in which all that flows into a node is known. Kind 0 passes on what is above 0, kind 1 (footprint
#: to trap) what is below.
_RAIN = "2.0 - (i + j) % 3"


def _flood(nodes: str, links: str) -> str:
    return f""",
el(src, dst, kind) AS ({links}),
nd(id, v) AS ({nodes}),
fl(id, v, wait) AS (
  SELECT nd.id, nd.v, coalesce(w.n, 0) FROM nd LEFT JOIN (SELECT dst, count(*) AS n FROM el GROUP BY 1) w ON w.dst = nd.id
  UNION ALL
  SELECT f.id, f.v + coalesce(g.s, 0), f.wait - coalesce(g.n, 0) FROM fl f LEFT JOIN (
    SELECT e.dst, sum(CASE WHEN e.kind = 0 THEN greatest(x.v, 0) ELSE least(x.v, 0) END) AS s, count(*) AS n FROM fl x JOIN el e ON e.src = x.id WHERE x.wait = 0 GROUP BY 1) g ON g.dst = f.id
  WHERE f.wait > 0),
flow AS (SELECT id, v FROM fl WHERE wait = 0)"""


_DRY = _flood(f"SELECT cell_id, {_RAIN} FROM rg", "SELECT cell_id, target, 0 FROM ptr WHERE target <> cell_id")
# lowest traps that spill into each other keep their water
_HALF = (
    _DOWN
    + """,
low AS (SELECT min_region AS region, down, down_cell, cur_cell, elevation FROM dn WHERE n_regions = 1),
lp AS (SELECT a.region FROM low a JOIN low b ON a.down = b.region AND b.down = a.region),
fr AS (SELECT low.* FROM low ANTI JOIN lp USING (region))"""
    + _flood(
        f"SELECT cell_id, {_RAIN} FROM rg UNION ALL SELECT -region, 0.0 FROM low",
        "SELECT cell_id, target, 0 FROM ptr WHERE target <> cell_id UNION ALL SELECT p.cell_id, -g.region, 0 FROM ptr p JOIN rg g USING (cell_id) WHERE p.target = p.cell_id AND g.region > 0 "
        "UNION ALL SELECT g.cell_id, -g.region, 1 FROM rg g JOIN fr ON fr.region = g.region AND g.z <= fr.elevation UNION ALL SELECT -region, down_cell, 0 FROM fr WHERE down <> 0 AND down_cell <> cur_cell",
    )
    + """,
kept AS (SELECT l.region, CASE WHEN lp.region IS NULL THEN 0.0 ELSE flow.v END AS region_accum FROM low l LEFT JOIN lp USING (region) JOIN flow ON flow.id = -l.region),
gone AS (SELECT greatest(flow.v, 0) AS v FROM flow JOIN ptr ON ptr.cell_id = flow.id AND ptr.target = ptr.cell_id JOIN rg ON rg.cell_id = flow.id WHERE rg.region < 0
  UNION ALL SELECT greatest(flow.v, 0) FROM fr JOIN flow ON flow.id = -fr.region WHERE down = 0 OR down_cell = cur_cell),
seep AS (SELECT (g.i + g.j) % 3 - CASE WHEN low.region IS NULL THEN greatest(-flow.v, 0) ELSE 0 END AS v FROM rg g JOIN flow ON flow.id = g.cell_id LEFT JOIN low ON low.region = g.region AND g.z <= low.elevation)"""
)
_BIG = "(SELECT arg_max(region, (n, region)) FROM (SELECT region, count(*) AS n FROM rg WHERE region > 0 GROUP BY 1))"
#: Names of the tables that directions and regions define, for a second raster beside the first.
_OWN = r"\b(hz|nb|sl|bs|fld|ptr|fe|fs|freach|froot|walk|ends|comps|nums|rg)\b"
_KEPT = "kx AS (SELECT k, least(n, 2 * k) AS at FROM dim, unnest(range(1, CAST(ceil(n / 2.0) AS BIGINT) + 1)) AS u(k))"
_TILE = "list_filter(range(0, {n}), lambda k: {c} >= 1 + (dim.n * k) // {n})[-1]"

ORACLES = {
    "dem_cells": _sql("", "SELECT cell_id, i, j, z FROM dem"),
    "grid_roundtrip": _sql("", "SELECT cell_id, i, j, z FROM dem"),
    # far apart along j, grids have no neighbours in each other
    "grid_directions": "WITH dem AS (SELECT cell_id AS cell, grid_id, min(grid_id * 10000000000 + cell_id) AS cell_id, min(i) AS i, min(grid_id * 10000000 + j) AS j, min(z) AS z, min(dir) AS given, min(dx) AS dx, min(dy) AS dy "
    "FROM cells LEFT JOIN (SELECT grid_id, max(len_x / nrows) AS dx, max(len_y / ncols) AS dy FROM grid_meta GROUP BY 1) USING (grid_id) GROUP BY 1, 2)"
    + _field(own="cell_id IN (SELECT cell_id FROM dem WHERE given = -2)", more=", dx, dy", steps=("(1 / c.dx)", "(1 / c.dy)", "(1 / sqrt(c.dx * c.dx + c.dy * c.dy))"))
    + " SELECT grid_id, dem.cell AS cell_id, CAST(dir AS TINYINT) AS dir, slope FROM fld JOIN dem USING (cell_id)",
    "grid_scan": _sql("", "SELECT cell_id, i, j, z FROM dem"),
    "tile_stats": _sql("", f"SELECT CAST({_TILE.format(n=4, c='i')} + 4 * {_TILE.format(n=3, c='j')} + 1 AS INT) AS tile, count(*) AS n, min(z) AS low, max(z) AS high FROM dem CROSS JOIN dim GROUP BY 1"),
    "spillfield_d8": _sql(_field(), _DIRS),
    "spillfield_d4": _sql(_field(diagonals=False), _DIRS),
    "spillfield_masked": _sql(_field(masked=True), _DIRS),
    "spillfield_update": _sql(_EDITED, _DIRS),
    "spillfield_vconcat": _sql(_field(), _DIRS),
    "spillfield_hconcat": _sql(_field(), _DIRS),
    "dir_histogram": _sql(_field(), "SELECT CAST(dir AS TINYINT) AS dir, count(*) AS n FROM fld GROUP BY 1"),
    "exit_cells": _sql(_field(), f"SELECT cell_id FROM fld CROSS JOIN dim WHERE {_EXIT}"),
    "flow_edges": _sql(_field() + _PTR, "SELECT cell_id, target FROM ptr WHERE target <> cell_id"),
    "flat_edges": _sql(_field() + _FLAT, "SELECT cell_id, neighbour FROM fe"),
    "spill_regions": _sql(_REG, "SELECT cell_id, region FROM rg"),
    "spill_regions_tiled": _sql(_REG, "SELECT cell_id, region FROM rg"),
    "spill_regions_update": _sql(_EDITED + _REGIONS, "SELECT cell_id, region FROM rg"),
    "region_sizes": _sql(_REG, "SELECT region, count(*) AS n_cells FROM rg GROUP BY 1"),
    "merged_outregions": _sql(_REG, "SELECT greatest(region, -1) AS region, count(*) AS n_cells FROM rg GROUP BY 1"),
    "region_adjacency": _sql(_REG + _SPILL, "SELECT src, dst, z_pass, cell, ncell FROM rag"),
    "spillpoints": _sql(
        _REG + _SPILL,
        "SELECT src AS region, dst AS downstream_region, cell AS current_region_cell, ncell AS downstream_region_cell, z_pass AS elevation "
        "FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY z_pass, phase, ord, pos) AS rn FROM rag) WHERE rn = 1",
    ),
    "trap_summary": _sql(_ALL, "SELECT min_region, n_regions, elevation, volume, coalesce(subvolume, 0) AS subvolume, n_cells FROM tr JOIN vol USING (k, comp) LEFT JOIN sub USING (k, comp)"),
    "masked_analysis": _sql(_MASKED, "SELECT min_region, n_regions, elevation, volume, coalesce(subvolume, 0) AS subvolume FROM tr JOIN vol USING (k, comp) LEFT JOIN sub USING (k, comp)"),
    "trap_parents": _sql(_ALL, "SELECT t.min_region, t.n_regions, q.min_region AS parent_min_region, q.n_regions AS parent_regions FROM tr t LEFT JOIN par p USING (k, comp) LEFT JOIN tr q ON q.k = p.pk AND q.comp = p.pcomp"),
    "toplevel_traps": _sql(_ALL, "SELECT min_region, n_regions FROM tr ANTI JOIN par USING (k, comp)"),
    "subtraps_closure": _sql(_ALL, "SELECT min_region, n_regions FROM tr SEMI JOIN par USING (k, comp)"),
    "trap_counts": _sql(_ALL, "SELECT (SELECT count(*) FROM regs) AS numregions, count(*) AS numtraps FROM tr"),
    "flow_accumulation": _sql(_REG, "SELECT cur AS cell_id, count(*) AS total FROM walk GROUP BY 1"),
    "region_inflow": _sql(_REG, "SELECT region, CAST(count(*) AS DOUBLE) AS region_accum FROM rg WHERE region > 0 GROUP BY 1"),
    "upstream_cells": _sql(_REG, "SELECT DISTINCT w.cell_id FROM walk w JOIN dem g ON g.cell_id = w.cur WHERE g.i % 25 = 0 AND g.j % 25 = 0"),
    "flat_areas": _sql(
        """, pr AS (SELECT a.cell_id AS u, b.cell_id AS v, abs(b.z - a.z) / n AS s FROM dem a CROSS JOIN dim JOIN dem b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1)),
lk AS (SELECT u, v FROM pr WHERE s < (SELECT max(s) FROM pr) * 0.02), ls AS (SELECT u, v FROM lk UNION SELECT v, u FROM lk),
fr(u, v) AS (SELECT u, u FROM ls UNION SELECT r.u, ls.v FROM fr r JOIN ls ON ls.u = r.v), fc AS (SELECT u, min(v) AS c FROM fr GROUP BY u),
big AS (SELECT c FROM fc GROUP BY c HAVING count(*) > 3)""",
        "SELECT d.cell_id, (b.c IS NOT NULL) AS is_flat FROM dem d LEFT JOIN fc ON fc.u = d.cell_id LEFT JOIN big b ON b.c = fc.c",
    ),
    "event_states": _EVENTS + "SELECT user_id, event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM e",
    "event_last": _EVENTS + "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM e WHERE value IS NOT NULL GROUP BY 1",
    "asof_state": _EVENTS
    + """, tp AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 7 DAYS)) AS tp FROM e),
c AS (SELECT tp, user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM tp JOIN e ON e.ts <= tp.tp GROUP BY ALL)
SELECT strftime(tp, '%Y-%m-%d %H:%M:%S') AS tp, user_id, event_id FROM c""",
    "region_selection": _sql(
        _ALL
        + """, top AS (SELECT t.k, t.comp, t.elevation FROM tr t ANTI JOIN par USING (k, comp)),
tmem AS (SELECT m.region, t.elevation, t.k, t.comp FROM top t JOIN mem m USING (k, comp)),
start AS (SELECT t.k, t.comp, CASE WHEN EXISTS (SELECT 1 FROM tmem x WHERE x.k = t.k AND x.comp = t.comp AND x.region = o.a) THEN o.ncell ELSE o.cell END AS cell_id
          FROM top t JOIN ord o ON o.k = t.k + 1),
river AS (SELECT DISTINCT w.cur AS cell_id FROM start s JOIN walk w USING (cell_id))""",
        "SELECT c.cell_id, CAST(CASE WHEN c.region > 0 AND c.z <= t.elevation THEN 2 WHEN r.cell_id IS NOT NULL THEN 3 WHEN t.region IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS color "
        "FROM rg c LEFT JOIN tmem t USING (region) LEFT JOIN river r ON r.cell_id = c.cell_id",
    ),
    # with every pond full and nothing seeping away, all rain leaves the domain
    "overflow_full_traps": _sql("", "SELECT CAST(count(*) AS DOUBLE) AS precipitation, 0.0::DOUBLE AS region_accum, CAST(count(*) AS DOUBLE) AS offregion_runoff, 0.0::DOUBLE AS used_infiltration FROM dem"),
    "mask_clusters": _sql(_MASK, "SELECT cell_id, cluster FROM cl"),
    "supertraps_of": _sql(_ALL, "SELECT m.region, string_agg(t.min_region || ':' || t.n_regions, ' ' ORDER BY t.n_regions, t.min_region) AS traps FROM mem m JOIN tr t USING (k, comp) GROUP BY 1"),
    "subtraps_nested": _sql(
        _ALL,
        "SELECT DISTINCT t.min_region, t.n_regions FROM tr t JOIN mem m ON m.region = t.min_region JOIN tr p ON p.k = m.k AND p.comp = m.comp AND p.n_regions > t.n_regions WHERE p.min_region % 3 <> 0",
    ),
    "trap_footprints": _sql(_ALL, "SELECT t.min_region, t.n_regions, c.cell_id FROM mem m JOIN tr t USING (k, comp) JOIN rg c ON c.region = m.region WHERE c.z <= t.elevation"),
    "trap_spillpoints": _sql(_ALL + _DOWN, "SELECT min_region, n_regions, elevation, CASE WHEN down <= 0 THEN -1 ELSE down END AS downstream_region, cur_cell AS current_region_cell, down_cell AS downstream_region_cell FROM dn"),
    "saturated_spillgraph_all": _sql(_ALL + _DOWN, "SELECT s.min_region, s.n_regions, coalesce(t.min_region, s.away) AS target_region, coalesce(t.n_regions, 0) AS target_regions FROM sg s LEFT JOIN tr t ON t.k = s.tk AND t.comp = s.tcomp"),
    "complete_spillgraph_all": _sql(_ALL + _DOWN + _complete("g", 5), "SELECT t.min_region, t.n_regions, g.to_region AS target_region, g.to_regions AS target_regions FROM g JOIN tr t USING (k, comp)"),
    "update_spillgraph_all": _sql(
        _ALL + _DOWN + _complete("a", 5) + _complete("b", 7),
        "SELECT t.min_region, t.n_regions, a.to_region AS old_target_region, a.to_regions AS old_target_regions, b.to_region AS new_target_region, b.to_regions AS new_target_regions "
        "FROM a FULL JOIN b USING (k, comp) JOIN tr t USING (k, comp) WHERE (a.to_region, a.to_regions) IS DISTINCT FROM (b.to_region, b.to_regions)",
    ),
    "invalid_full_traps": _sql(_ALL, "SELECT DISTINCT t.min_region, t.n_regions FROM tr t JOIN par p ON p.pk = t.k AND p.pcomp = t.comp JOIN tr c ON c.k = p.k AND c.comp = p.comp WHERE t.min_region % 2 = 0 AND c.min_region % 2 <> 0"),
    "upstream_regions": _sql(_ALL + _DOWN + _TOP + _above(f"SELECT k, comp FROM tmem WHERE region = {_BIG}"), "SELECT region FROM upr"),
    "upstream_area": _upstream("SELECT arg_max(cell_id, (z, cell_id)) AS cell_id FROM rg WHERE region > 0"),
    "upstream_area_river": _upstream("SELECT arg_max(c.cell_id, (a.n, c.cell_id)) AS cell_id FROM rg c JOIN tmem t ON t.region = c.region AND c.z > t.elevation JOIN (SELECT cur AS cell_id, count(*) AS n FROM walk GROUP BY 1) a ON a.cell_id = c.cell_id"),
    "upstream_area_pond": _upstream(f"SELECT arg_min(cell_id, (z, cell_id)) AS cell_id FROM rg WHERE region = {_BIG}"),
    "watercourses_infil": _sql(_REG + _DRY, "SELECT id AS cell_id, CAST(v AS DOUBLE) AS runoff FROM flow"),
    "runoff_half_full": _sql(_ALL + _HALF, "SELECT id AS cell_id, CAST(v AS DOUBLE) AS runoff FROM flow WHERE id > 0"),
    "inflow_half_full": _sql(_ALL + _HALF, "SELECT region, CAST(region_accum AS DOUBLE) AS region_accum FROM kept"),
    "watercourses_half_full": _sql(
        _ALL + _HALF,
        "SELECT (SELECT CAST(2 * count(*) AS DOUBLE) FROM rg) AS precipitation, (SELECT CAST(sum(region_accum) AS DOUBLE) FROM kept) AS region_accum, "
        "(SELECT CAST(sum(v) AS DOUBLE) FROM gone) AS offregion_runoff, (SELECT CAST(sum(v) AS DOUBLE) FROM seep) AS used_infiltration",
    ),
    "region_reindex": _sql(
        _field() + _REGIONS + _EDIT + re.sub(_OWN, r"\1_2", _field("dem2") + _REGIONS),
        "SELECT DISTINCT a.region AS old_region, b.region AS new_region FROM rg a JOIN rg_2 b USING (cell_id)",
    ),
    "region_remap": _sql(_REG, "SELECT cell_id, CASE WHEN region % 2 = 0 THEN -region ELSE region END AS region FROM rg"),
    "mesh_faces": _sql("", "SELECT cell_id AS a, cell_id + 1 AS b, cell_id + 1 + n AS c, cell_id + n AS d FROM dem CROSS JOIN dim WHERE i < n AND j < n"),
    "mesh_geometry": _sql(
        f""", {_KEPT}, st AS (SELECT n, n / (count(*) - 1.0) AS d FROM kx CROSS JOIN dim GROUP BY n),
mg AS (SELECT a.k AS i, b.k AS j, z FROM dem JOIN kx a ON a.at = dem.i JOIN kx b ON b.at = dem.j),
gr AS (SELECT *, z - lag(z) OVER (PARTITION BY j ORDER BY i) AS a, lead(z) OVER (PARTITION BY j ORDER BY i) - z AS b, z - lag(z) OVER (PARTITION BY i ORDER BY j) AS c, lead(z) OVER (PARTITION BY i ORDER BY j) - z AS e FROM mg),
nm AS (SELECT i, j, z, n, d, (coalesce(a, b) + coalesce(b, a)) / (2 * d) AS gx, (coalesce(c, e) + coalesce(e, c)) / (2 * d) AS gy FROM gr CROSS JOIN st),
un AS (SELECT *, sqrt(gx * gx + gy * gy + 1) AS len, (i - 1) * CAST(d AS DOUBLE) AS x, (j - 1) * CAST(d AS DOUBLE) AS y FROM nm)""",
        "SELECT i, j, z * 0.5 AS z, round(x, 9) AS x, round(y, 9) AS y, round(x / n, 9) AS u, round(y / n, 9) AS v, round(gx / len, 9) AS nx, round(gy / len, 9) AS ny, round(1 / len, 9) AS nz FROM un",
    ),
    "zvol_tables_all": _sql(
        _ALL
        + """, fo AS (SELECT p.pk AS k, p.pcomp AS comp, max(t.elevation) AS floor FROM par p JOIN tr t USING (k, comp) GROUP BY ALL),
cz AS (SELECT m.k, m.comp, greatest(c.z, coalesce(fo.floor, c.z)) AS z, 1 AS n FROM mem m JOIN rg c ON c.region = m.region AND c.z <= m.elevation LEFT JOIN fo USING (k, comp)
       UNION ALL SELECT k, comp, elevation, 0 FROM tr),
cs AS (SELECT k, comp, z, CAST(sum(n) AS DOUBLE) AS n FROM cz GROUP BY ALL)""",
        "SELECT t.min_region, t.n_regions, z, z * sum(n) OVER w - sum(n * z) OVER w AS volume FROM cs JOIN tr t USING (k, comp) WINDOW w AS (PARTITION BY k, comp ORDER BY z)",
    ),
    **{
        f"flatten_{h}": _sql(_MASK, f"SELECT d.cell_id, coalesce(l.z, d.z) AS z FROM dem d LEFT JOIN cl USING (cell_id) LEFT JOIN (SELECT cluster, {f}(z) AS z FROM cl JOIN mk USING (cell_id) GROUP BY 1) l USING (cluster)")
        for h, f in (("min", "min"), ("max", "max"), ("mean", "avg"))
    },
}

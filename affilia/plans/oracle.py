"""The queries as DuckDB SQL, independent of the operators."""

from __future__ import annotations

from ..sources import views

BIG = 4294967296


#: student, course and grad flag of the two rosters
ROSTER = "o_custkey::bigint", "l_partkey::bigint", "c_custkey % 4 = 0"
ISLANDS = "l_orderkey::bigint", "o_custkey * 64 + split_part(p_brand, '#', 2)::bigint", "o_orderkey % 4 = 0"


def base(weighted: bool = True, of=ROSTER) -> str:
    """CTEs: en (rows), pr (distinct pairs), cr (courses), st (students), ed (edges), ee (both ways)."""
    hours = "(1 + p_size % 4)::bigint" if weighted else "1::bigint"
    return f"""en as materialized (select l_orderkey * 8 + l_linenumber as row_id, {of[0]} as stid, {of[1]} as crsid,
      (c_nationkey % 6 + 1)::int as major, {of[2]} as grad, {hours} as hours
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey),
    pr as materialized (select distinct stid, crsid from en),
    cr as materialized (select crsid, max_by(hours, row_id) as hours, sum(hours)::bigint as cost, count(*) as degree from en group by crsid),
    st as materialized (select stid, max_by(major, row_id) as major, max_by(grad, row_id) as grad from en group by stid),
    ed as materialized (select stid * 2 as a, crsid * 2 + 1 as b from pr),
    ee as materialized (select a, b from ed union all select b, a from ed)"""


def thresholds(less: int = 0, sizes=None) -> str:
    """CTEs: th (threshold_id, min_size), bu (threshold_id, max_cost)."""
    rows = ", ".join(["(0, null::bigint)", *(f"({k}, {s}::bigint)" for k, s in enumerate(sizes or views.SIZES, 1))])
    return f"""th(threshold_id, min_size) as (values {rows}),
    tt as (select threshold_id, min_size, count(crsid) as n_courses, coalesce(sum(cost), 0)::bigint as cost from th left join cr on degree >= min_size group by 1, 2),
    bu as materialized (select threshold_id, greatest(cost - {less}, 0)::bigint as max_cost from tt),
    sp as (select *, sum(cost) over (order by degree desc, crsid rows unbounded preceding) as spent from cr),
    rm as materialized (select threshold_id, crsid, cost from sp join bu on spent <= max_cost)"""


def with_(*parts: str, then: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + then


# the graph parts are keyed by t, so a whole sweep is one graph; they read g(t, a, b), both ways
G0 = "g as materialized (select 0 as t, a, b from ee)"
CC = """cl(t, v, l) using key (t, v) as (select distinct t, a, a from g
      union (select g.t, g.b, min(cl.l) from cl join g on cl.t = g.t and cl.v = g.a
             join recurring.cl k on k.t = g.t and k.v = g.b where cl.l < k.l group by g.t, g.b)),
    cc as materialized (select t, v, l from cl),
    cs as materialized (select t, l, count(*) filter (where v % 2 = 0) as n_students, count(*) as n_vertices from cc group by t, l),
    big as materialized (select t, arg_max(l, (n_students, -l)) as l, max(n_students) as n from cs group by t)"""
BLOCKS = f"""wo(t, x, v, l) using key (t, x, v) as (
      select x.t, x.v, y.v, y.v from cc x join cc y on x.t = y.t and x.l = y.l and x.v <> y.v
      union (select r.t, r.x, g.b, min(r.l) from wo r join g on r.t = g.t and r.v = g.a and g.b <> r.x
             join recurring.wo k on k.t = r.t and k.x = r.x and k.v = g.b where r.l < k.l group by 1, 2, 3)),
    ei as materialized (select t, a, b, least(a, b) * {BIG} + greatest(a, b) as id from g),
    rel as materialized (select distinct p.t, p.id as i, q.id as j from ei p join ei q on p.t = q.t and p.a = q.a
      join wo r1 on r1.t = p.t and r1.x = p.a and r1.v = p.b join wo r2 on r2.t = p.t and r2.x = p.a and r2.v = q.b where r1.l = r2.l),
    bl(t, i, l) using key (t, i) as (select distinct t, id, id from ei
      union (select rel.t, rel.j, min(bl.l) from bl join rel on bl.t = rel.t and bl.i = rel.i
             join recurring.bl k on k.t = rel.t and k.i = rel.j where bl.l < k.l group by 1, 2)),
    bm as materialized (select distinct bl.t, (bl.l // {BIG})::varchar || '-' || (bl.l % {BIG})::varchar as block_id, e.a as vid from bl join ei e on e.t = bl.t and e.id = bl.i)"""
UNIT_PATHS = """sv as materialized (select distinct t, a as v from g),
    pa(t, s, v, d, n) using key (t, s, v) as (
      select t, v, v, 0, 1::double from sv
      union (select r.t, r.s, g.b, any_value(r.d) + 1, sum(r.n) from pa r join g on r.t = g.t and r.v = g.a
             left join recurring.pa k on k.t = r.t and k.s = r.s and k.v = g.b where k.s is null group by r.t, r.s, g.b)),
    p as materialized (select * from pa)"""
WEIGHTED_PATHS = """sv as materialized (select distinct t, a as v from g),
    di(t, s, v, d) using key (t, s, v) as (
      select t, v, v, 0::bigint from sv
      union (select r.t, r.s, g.b, min(r.d + g.len) from di r join g on r.t = g.t and r.v = g.a
             left join recurring.di k on k.t = r.t and k.s = r.s and k.v = g.b
             where k.d is null or r.d + g.len < k.d group by r.t, r.s, g.b)),
    dm as materialized (select * from di),
    dag as materialized (select x.t, x.s, g.a, g.b from dm x join g on x.t = g.t and x.v = g.a join dm y on y.t = x.t and y.s = x.s and y.v = g.b and y.d = x.d + g.len),
    pc(t, s, v, n) as (select t, v, v, 1::double from sv
      union all (select pc.t, pc.s, dag.b, sum(pc.n) from pc join dag on dag.t = pc.t and dag.s = pc.s and dag.a = pc.v group by 1, 2, 3)),
    p as materialized (select t, s, v, any_value(d) as d, sum(n) as n from pc join dm using (t, s, v) group by t, s, v)"""
#: only sources of the largest component
IN_LARGEST = "      join cc o on o.t = x.t and o.v = x.s join big on big.t = x.t and big.l = o.l\n"
SCORES = f"""bs as (select x.t, x.v, sum(x.n * y.n / z.n) as raw
      from p x join p y on y.t = x.t and y.s = x.v join p z on z.t = x.t and z.s = x.s and z.v = y.v and z.d = x.d + y.d
{IN_LARGEST}      where x.s <> x.v and y.v <> x.v and x.s <> y.v group by x.t, x.v),
    sc as materialized (select cc.t, cc.v as vid, coalesce(raw, 0) as raw from cc left join bs on bs.t = cc.t and bs.v = cc.v),
    nn as (select t, count(*) as n from cc group by t)"""
ALL_SCORES = SCORES.replace(IN_LARGEST, "")
NORM1 = "case when n > 2 then 1.0 / ((n - 2) * (n - 1)) else 0 end"
LIVE = """bigc as (select crsid * 2 + 1 as vid from cr where degree >= {masked}),
    vt as (select distinct a as vid from ee), lv as materialized (select vid from vt where vid not in (select vid from bigc)),
    le as materialized (select a, b from ed where a in (select vid from lv) and b in (select vid from lv)),
    l2 as materialized (select a, b from le union all select b, a from le)"""
CLASSES = """nb as (select stid, list(crsid order by crsid) as nbr from pr group by stid),
    cla as materialized (select min(stid) as cid, grad, nbr, count(*) as mult from nb join st using (stid) group by grad, nbr),
    ce as (select cid, mult, unnest(nbr) as crsid from cla),
    cw as (select ce.*, 12 // hours as length, min(12 // hours) over (partition by cid) as least from ce join cr using (crsid)),
    ne as (select cid, crsid, mult, length from cw where length = least)"""


def _report(only: str = "true") -> str:
    live = """vy as (select t.threshold_id as t, pr.stid, pr.crsid from pr cross join (select threshold_id from bu) t
        where not exists (select 1 from rm where rm.threshold_id = t.threshold_id and rm.crsid = pr.crsid)),
      g as materialized (select t, stid * 2 as a, crsid * 2 + 1 as b from vy union all select t, crsid * 2 + 1, stid * 2 from vy)"""
    return with_(
        base(weighted=False, of=ISLANDS), thresholds(sizes=views.ISLAND_SIZES), live, CC, BLOCKS, UNIT_PATHS, SCORES,
        then=f"""select bu.threshold_id, coalesce(r.c, 0)::bigint as removed_cost,
        q::bigint as n_vertices, coalesce(i.n, 0) as included, round(100.0 * coalesce(i.n, 0) / s.n, 1)::double as included_pct,
        coalesce(big.n, 0) as max_cc, round(100.0 * coalesce(big.n, 0) / s.n, 1)::double as max_cc_pct,
        coalesce(b.n, 0) as max_bcc, round(100.0 * coalesce(b.n, 0) / s.n, 1)::double as max_bcc_pct,
        round(coalesce(m.raw, 0) * case when q > 2 then 1.0 / ((q - 2) * (q - 1)) else 0 end, 9) as max_bc
      from bu left join (select threshold_id, sum(cost) as c, count(*) as k from rm group by 1) r using (threshold_id)
      left join (select t, count(distinct stid) as n from vy group by t) i on i.t = bu.threshold_id
      left join big on big.t = bu.threshold_id
      left join (select t, max(n) as n from (select t, block_id, count(*) filter (where vid % 2 = 0) as n from bm group by 1, 2) group by t) b on b.t = bu.threshold_id
      left join (select t, max(raw) as raw from sc group by t) m on m.t = bu.threshold_id
      cross join (select count(*) as n from st) s cross join (select count(*) as n from cr) c
      cross join lateral (select coalesce(i.n, 0) + c.n - coalesce(r.k, 0) as q) where {only}""",
    )


def sql() -> dict[str, str]:
    """SQL by query."""
    return _sql(base(), LIVE.format(masked=views.MASKED_DEGREE))


def _sql(full: str, live: str) -> dict[str, str]:
    parts, parts_live = base(of=ISLANDS), LIVE.format(masked=views.ISLAND_MASKED_DEGREE)
    blocks = (parts, G0, CC, BLOCKS)
    cuts = "ct as (select vid, count(*) as n_blocks from bm group by vid having count(*) > 1)"
    tiny_weighted = "g as materialized (select 0 as t, ee.a, ee.b, 12 // hours as len from ee join cr on (case when a % 2 = 1 then a else b end) = crsid * 2 + 1)"
    bicuts = "select block_id, count(ct.vid) as cut_count from bm left join ct using (vid) group by block_id"
    live_g = "g as materialized (select 0 as t, a, b from l2)"
    return {
        "scan_roster": with_(full, then="select stid, crsid, major, grad, hours from en"),
        "dict_encode": with_(full, then="select 's' as kind, stid as id, dense_rank() over (order by stid) - 1 as code from st union all select 'c', crsid, dense_rank() over (order by crsid) - 1 from cr"),
        "infer_cardinality": with_(full, then="select max(stid) as n_students, max(crsid) as n_courses from en"),
        "student_attrs": with_(full, then="select stid, major, grad from st"),
        "type_pack": with_(full, then="select stid, (major * 2 + grad::int)::int as type, major, grad, true as is_student from st"),
        "course_cost": with_(full, then="select crsid, cost from cr"),
        "course_degree": with_(full, then="select crsid, degree from cr"),
        "student_neighborhood": with_(full, then="select stid, count(*) as degree, string_agg(crsid::varchar, ',' order by crsid) as nbr from pr group by stid"),
        "rank_courses": with_(full, then="select crsid, degree, row_number() over (order by degree desc, crsid) as rank from cr"),
        "masked_degrees": with_(full, live, then="select vt.vid, count(l2.b) as degree from vt left join l2 on l2.a = vt.vid group by vt.vid"),
        "included_students": with_(full, then=f"select distinct stid from pr join cr using (crsid) where degree < {views.MASKED_DEGREE}"),
        "non0_vertices": with_(full, live, then="select distinct a as vid from l2"),
        "undergrad_subgraph": with_(full, then="select stid, crsid from pr join st using (stid) where not grad"),
        "induced_edges": with_(full, live, then="select a, b from le"),
        "co_enrolment": with_(full, then="select x.stid as st1, y.stid as st2, count(*) as n_shared from pr x join pr y using (crsid) where x.stid < y.stid group by 1, 2"),
        "size_threshold_costs": with_(full, thresholds(), then="select threshold_id, min_size, cost from tt"),
        "size_threshold_counts": with_(full, thresholds(), then="select threshold_id, min_size, n_courses, cost from tt"),
        "budget_prefix_removed": with_(full, thresholds(1), then="select threshold_id, crsid from rm"),
        "budget_prefix_summary": with_(full, thresholds(1), then="select threshold_id, max_cost, count(crsid) as n_removed, coalesce(sum(rm.cost), 0)::bigint as removed_cost from bu left join rm using (threshold_id) group by 1, 2"),
        "budget_greedy_removed": with_(
            full, thresholds(1), "o as materialized (select *, row_number() over (order by degree desc, crsid) as rn from cr)",
            "gr(t, budget, rn, tc, crs, taken) as (select threshold_id, max_cost, 0::bigint, 0::bigint, null::bigint, false from bu union all select gr.t, gr.budget, o.rn, case when gr.tc + o.cost <= gr.budget then gr.tc + o.cost else gr.tc end, o.crsid, gr.tc + o.cost <= gr.budget from gr join o on o.rn = gr.rn + 1)",
            then="select t as threshold_id, crs as crsid from gr where taken",
        ),
        "contract_students": with_(full, CLASSES, then="select cid, grad, mult, len(nbr)::bigint as degree from cla"),
        "contracted_edges": with_(full, CLASSES, then="select cid, crsid from ce"),
        "contracted_degree": with_(full, CLASSES, then="select crsid, count(*) as degree from ce group by crsid"),
        "compress_graph": with_(
            full, "nv as (select a as vid, list(b order by b) as nbr from ee group by a)", "kw as (select vid, nbr, vid % 2 = 0 as in_src, coalesce(hours, 0) as weight from nv left join cr on vid = crsid * 2 + 1)",
            then="select min(vid) as cid, in_src, weight, count(*) as mult from kw group by in_src, weight, nbr",
        ),
        "min_weight_neighbors": with_(full, CLASSES, then="select cid, mult, length, count(*) as n_nearest from ne group by 1, 2, 3"),
        "internal_pair_bc": with_(parts, CLASSES, "wy as (select cid, count(*) as ways from ne group by cid)", then="select crsid, round(sum(mult * (mult - 1) / ways::double), 9) as score from ne join wy using (cid) where mult > 1 group by crsid"),
        "connected_components": with_(full, G0, CC, then="select v as vid, l as comp_id from cc"),
        "cc_sizes": with_(full, G0, CC, then="select l as comp_id, n_students, n_vertices from cs"),
        "largest_component": with_(full, G0, CC, then="select l as comp_id, n_students, n_vertices from cs order by n_students desc, l limit 1"),
        "component_student_sizes": with_(full, G0, CC, then="select n_students, count(*) as n_components from cs group by n_students"),
        "biconnected_components": with_(*blocks, then="select block_id, vid from bm"),
        "bicomponents_generic": with_(parts, parts_live, live_g, CC, BLOCKS, then="select block_id, vid from bm union all select vid::varchar || '-' || vid::varchar, vid from lv where vid not in (select vid from bm)"),
        "largest_block": with_(*blocks, "sz as (select block_id, count(*) filter (where vid % 2 = 0) as s, count(*) as n from bm group by 1)", then="select max(s) as max_bcc, max(n) as max_vertices, arg_max(s, (n, s)) as students_of_max_vertices from sz"),
        "cut_vertices": with_(*blocks, cuts, then="select vid, n_blocks from ct"),
        "block_cut_counts": with_(*blocks, cuts, then=bicuts),
        "block_cut_forest": with_(
            *blocks, cuts, f"bc as ({bicuts})", "bk as (select cc.l as comp_id, bm.block_id, count(*) as n_vertices from bm join cc on cc.v = bm.vid group by 1, 2)",
            then="""select bk.comp_id, block_id, bk.n_vertices, cut_count, cs.n_vertices as comp_vertices,
            count(*) filter (where cut_count <= 1) over (partition by bk.comp_id) as leaf_count from bk join bc using (block_id) join cs on cs.l = bk.comp_id""",
        ),
        "bfs_distances": with_(parts, G0, UNIT_PATHS, then="select s, v, d::bigint as distance from p"),
        "shortest_path_counts": with_(parts, G0, UNIT_PATHS, then="select s, v, n as n_paths from p"),
        "betweenness": with_(parts, G0, CC, UNIT_PATHS, SCORES, then=f"select vid, round(raw * {NORM1}, 9) as score from sc join nn using (t)"),
        "betweenness_norms": with_(parts, G0, CC, UNIT_PATHS, SCORES, then=f"select vid, round(raw * 0.5, 9) as norm0, round(raw * {NORM1}, 9) as norm1, round(raw / (n * (n - 1)), 9) as norm2 from sc join nn using (t)"),
        "max_betweenness": with_(parts, G0, CC, UNIT_PATHS, SCORES, then=f"select max(round(raw * {NORM1}, 9)) as max_bc from sc join nn using (t)"),
        "weighted_betweenness": with_(parts, tiny_weighted, CC, WEIGHTED_PATHS, ALL_SCORES, then=f"select vid, round(raw * {NORM1}, 9) as score from sc join nn using (t)"),
        "block_cut_betweenness": with_(
            parts, G0, UNIT_PATHS,
            """pb as (select x.v, sum(x.n * y.n / z.n) as raw from p x join p y on y.s = x.v join p z on z.s = x.s and z.v = y.v and z.d = x.d + y.d
      where x.s <> x.v and y.v <> x.v and x.s <> y.v group by x.v)""",
            then="select sv.v as vid, round(coalesce(raw, 0), 9)::double as score from sv left join pb on pb.v = sv.v",
        ),
        "report_row": _report("bu.threshold_id = 2"),
        "threshold_report": _report(),
    }

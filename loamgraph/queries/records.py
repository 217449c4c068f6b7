"""Queries of the record and track problems (p1 to p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.operators import heavykeys, orphans, spatial, timestamps, trips

#: Normalises written ids in SQL: (raw column, table) -> id.
_ID = r"""
  select *, coalesce((select min(c.prefix || ':' || substr(v, length(c.iri) + 1)) from jsonld_context c where starts_with(v, c.iri)), v) id
  from (select *, case when regexp_matches(s, '"@id"\s*:\s*"') then regexp_extract(s, '"@id"\s*:\s*"([^"]*)"', 1)
                       when starts_with(s, '[') then regexp_extract(s, '^\[\s*"([^"]*)"\s*\]$', 1) else s end v
        from (select *, regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') s from (%s)))
"""

_P1 = rf"""
with named as ({_ID % '''
    select 'tracking_report' ref_table, _id rec, bold_animal raw from tracking_report where bold_animal is not null
    union all
    select 'import_result', run_id, e.resource from (select run_id, unnest(errors) e from import_result) where e.resource is not null'''}),
t_ind as (select _id, min(loaded_at) l, min(deleted_at) d from individual group by 1),
t_rep as (select _id, min(loaded_at) l, null::timestamp d from tracking_report group by 1),
t_obs as (select _id, min(loaded_at) l, null::timestamp d from observation group by 1),
records as (select * from t_ind union all select * from t_rep union all select * from t_obs),
runs as (select run_id, min(finished_at) f from import_result group by 1),
refs as (
  select distinct n.ref_table, n.rec, n.id, t_rep.l tm, i._id hit, i.l l, i.d d
  from named n join t_rep on n.rec = t_rep._id left join t_ind i on n.id = i._id where ref_table = 'tracking_report' and id <> ''
  union all
  select distinct n.ref_table, n.rec, n.id, runs.f, a._id, a.l, a.d
  from named n join runs on n.rec = runs.run_id left join records a on n.id = a._id where ref_table = 'import_result' and id not in ('', 'unknown')),
found as (
  select distinct ref_table, rec record_id, id target_id, 'missing' reason, strftime(tm, '%Y-%m') ref_month from refs where hit is null
  union select distinct ref_table, rec, id, 'later', strftime(tm, '%Y-%m') from refs where l > tm
  union select distinct ref_table, rec, id, 'deleted', strftime(tm, '%Y-%m') from refs where d <= tm)
"""

_POINTS = """
points as (
  select _id, p.la la, p.lo lo from (select _id, min_by({'la': geo_lat, 'lo': geo_long}, loaded_at) p from observation group by 1)
  where p.la between -90 and 90 and p.lo between -180 and 180 and not isnan(p.la) and not isnan(p.lo) and not (p.la = 0 and p.lo = 0))
"""

_NEAR = """
  select 'near' relation, a._id left_id, b._id right_id from points a join points b
  on b.la between a.la - 0.0006 and a.la + 0.0006 and a._id < b._id
  where 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= 50
"""

_WITHIN = """
  select distinct 'within' relation, pid left_id, rid right_id from (
    select p._id pid, e._id rid, e.poly, count(*) n from points p join edges e
    on (e.ay > p.la) <> (e.y2 > p.la) and p.lo < (e.x2 - e.ax) * (p.la - e.ay) / (e.y2 - e.ay) + e.ax
    group by all) where n % 2 = 1
"""

_EDGES = """
depictions as (select _id, bold_spatialdepiction::json j from study_region where json_valid(bold_spatialdepiction)),
features as (select _id, unnest(case when json_type(j) = 'ARRAY' then from_json(j, '["json"]') else [j] end) f from depictions),
geometries as (select _id, coalesce(f -> 'geometry', f) g from features),
polygons as (
  select _id, poly, rings from (
    select _id, row_number() over () poly, from_json(p, '[[["double"]]]') rings from (
      select _id, unnest(case g ->> 'type' when 'Polygon' then [g -> 'coordinates'] when 'MultiPolygon' then from_json(g -> 'coordinates', '["json"]') end) p from geometries))
  where len(list_distinct(rings[1])) >= 3),
rings as (select _id, poly, unnest(rings) r from polygons),
edges as (
  select _id, poly, r[i][1] ax, r[i][2] ay, r[i % len(r) + 1][1] x2, r[i % len(r) + 1][2] y2
  from (select _id, poly, r, unnest(range(1, len(r) + 1)) i from rings))
"""

_P4 = rf"""
with named as ({_ID % "select bold_animal raw, case when abs(_when_ms) < 100000000000 then _when_ms * 1000 else _when_ms end t, _h3_7 from tracking_report"})
"""


def queries() -> dict:
    return {
        "p1_found": orphans.orphans_of,
        "p1_monthly": lambda s, d: orphans.orphan_counts(orphans.orphans_of(s, d)),
        "p2_found": spatial.relations_of,
        "p2_degree": lambda s, d: spatial.degrees_of(s, d),
        "p3_found": lambda s, d: timestamps.bounds_of(s, d).where("utc_ms is not null").select(F.col("id").alias("individual_id"), "prop", "utc_ms").distinct(),
        "p3_masks": lambda s, d: timestamps.mask_counts(timestamps.bounds_of(s, d)),
        "p4_found": heavykeys.heavy_of,
        "p4_profile": heavykeys.profile_of,
        "p5_method": lambda s, d: trips.trips_of(s, d, by_segments=True).select("kind", "animal_id", "collar", "start_ms", "end_ms", "n_pings", F.round("distance_m", 3).alias("distance_m")),
        "p5_found": lambda s, d: trips.trips_of(s, d).select("kind", "animal_id", "collar", "start_ms", "end_ms"),
        "p5_totals": lambda s, d: trips.totals(trips.trips_of(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "select * from found",
        "p1_monthly": _P1 + "select ref_table, ref_month, reason, count(*) n_references, count(distinct target_id) n_targets from found group by all",
        "p2_found": f"with {_POINTS}, {_EDGES} {_NEAR} union all {_WITHIN}",
        "p2_degree": f"with {_POINTS}, {_EDGES}, links as ({_NEAR}), held as ({_WITHIN}), ends as (select left_id id from links union all select right_id from links) "
        "select p._id observation_id, (select count(*) from ends where ends.id = p._id) n_near, (select count(*) from held where held.left_id = p._id) n_regions from points p",
        "p4_found": _P4 + "select id animal_id from named where id <> '' group by 1 having count(*) * 1000 >= 45 * (select count(*) from tracking_report)",
        "p4_profile": _P4 + "select id animal_id, count(*) n_rows, min(t) first_ms, max(t) last_ms, count(distinct _h3_7) n_cells from named where id <> '' group by 1",
    }

"""DuckDB SQL twins of the registered queries, written against the driver's tables."""

from __future__ import annotations

from ledgerlens.fixed_values import FIELD_MEANINGS

LOANS = """
l1 as (
  select l_orderkey, min(l_partkey) as l_partkey, max(l_suppkey) as l_suppkey
  from lineitem group by l_orderkey),
loans as (
  select o.o_orderkey as loan_id, o.o_custkey as borrower_id, c.c_name as borrower_name,
    '07' || lpad(cast(l1.l_partkey*100 + l1.l_suppkey%100 as varchar), 8, '0') as phone_number,
    'NIN' || lpad(cast(c.c_custkey - c.c_custkey%2 as varchar), 9, '0') as national_id,
    round(o.o_totalprice/1000.0)*1000.0*(case when o.o_orderkey%97=0 then 10 else 1 end) as amount,
    cast(o.o_orderdate as date) as loan_date, e.ts as created_at,
    strftime(e.ts, '%H:%M:%S') as approval_time,
    l1.l_suppkey as officer_id, s.s_name as officer_name,
    c.c_nationkey as branch_id, n.n_name as branch_name,
    case o.o_orderstatus when 'O' then 'active' when 'F' then 'completed' else 'defaulted' end as status,
    p.p_type as product_id, p.p_name || ' ' || p.p_brand as guarantor_name,
    (o.o_custkey%50)*0.001::double as latitude, (l1.l_partkey%40)*0.001::double as longitude
  from orders o
  left join l1 on l1.l_orderkey = o.o_orderkey
  left join customer c on c.c_custkey = o.o_custkey
  left join nation n on n.n_nationkey = c.c_nationkey
  left join supplier s on s.s_suppkey = l1.l_suppkey
  left join part p on p.p_partkey = l1.l_partkey
  left join events e on e.event_id = o.o_orderkey)"""


def _with(*ctes: str) -> str:
    return "with " + ",".join([LOANS, *ctes]) + "\n"


def _alert(
    source: str,
    alert_type: str,
    severity: str,
    title: str,
    description: str,
    amount: str,
    officer: str,
    key: str,
    loan_count: str,
    evidence: str | None = None,
) -> str:
    extra = f", {evidence}" if evidence else ""
    return f"""
select sha256('{alert_type}' || '|' || {key}) as alert_id, '{alert_type}' as alert_type, {severity} as severity,
  '{title}' as title, {description} as description, round(cast({amount} as double), 2) as amount_at_risk,
  'rule' as detection_method, cast({officer} as varchar) as officer_id, {key} as entity_key,
  cast({loan_count} as bigint) as loan_count{extra}
from {source}"""


# --- rule detectors: named blocks of CTEs plus the alert projection ---------------------------------------------

_GHOST_CTE = """
g1 as (
  select phone_number, count(distinct borrower_id) as borrower_count, count(loan_id) as loan_count, sum(amount) as total
  from loans where phone_number is not null group by 1 having count(distinct borrower_id) >= 2),
g1_officer as (
  select phone_number, officer_id from (
    select phone_number, officer_id,
      row_number() over (partition by phone_number order by count(*) desc, officer_id) as rn
    from loans where phone_number is not null and officer_id is not null group by 1, 2) where rn = 1),
g1_names as (
  select phone_number, list(borrower_name order by borrower_name)[1:5] as names
  from (select distinct phone_number, borrower_name from loans
        where phone_number is not null and borrower_name is not null) group by 1),
ghosts as (select * from g1 left join g1_officer using (phone_number) left join g1_names using (phone_number))"""

_GHOST = _alert(
    "ghosts",
    "ghost_loan",
    "'HIGH'",
    "Phone shared by several borrowers",
    "borrower_count || ' borrowers share phone number ' || phone_number",
    "total",
    "officer_id",
    "phone_number",
    "loan_count",
)
_GHOST_EVIDENCE = "borrower_count, array_to_string(names, ', ') as borrower_names"

_OFFICER_CTE = """
o1 as (
  select officer_id, count(loan_id) as loan_count, sum(amount) as total_amount, avg(amount) as avg_amount,
    arg_min(officer_name, loan_id) as officer_name, arg_min(branch_name, loan_id) as branch_name
  from loans where officer_id is not null group by 1),
o2 as (
  select *, (loan_count - avg(loan_count) over ()) / nullif(stddev_pop(loan_count) over (), 0) as volume_z,
    (avg_amount - avg(avg_amount) over ()) / nullif(stddev_pop(avg_amount) over (), 0) as amount_z,
    count(*) over () as officers
  from o1),
odd_officers as (select * from o2 where officers > 2 and (abs(volume_z) > 2 or abs(amount_z) > 2))"""

_OFFICER = _alert(
    "odd_officers",
    "unusual_approval",
    "case when volume_z > 2.5 then 'HIGH' else 'MEDIUM' end",
    "Officer unlike the others",
    "'Officer ' || officer_name || ': ' || loan_count || ' loans, ' || printf('%.1f', volume_z)"
    " || ' deviations from the mean'",
    "total_amount * 0.1",
    "officer_id",
    "cast(officer_id as varchar)",
    "loan_count",
)
_OFFICER_EVIDENCE = "round(volume_z, 6) as volume_z, round(avg_amount, 4) as avg_amount, branch_name as branch"

_GEO_CTE = """
c1 as (
  select *, round(latitude, 3) as cell_lat, round(longitude, 3) as cell_lon from loans
  where latitude is not null and longitude is not null and officer_id is not null),
cells as (
  select officer_id, cell_lat, cell_lon, count(*) as cluster_size, sum(amount) as total, avg(latitude) as clat,
    avg(longitude) as clon, list(borrower_name order by loan_id)[1:5] as names
  from c1 group by 1, 2, 3 having count(*) >= 3)"""

_GEO_KEY = (
    "cast(officer_id as varchar) || '|' || cast(cast(round(cell_lat*1000) as bigint) as varchar) || '|' ||"
    " cast(cast(round(cell_lon*1000) as bigint) as varchar)"
)
_GEO = _alert(
    "cells",
    "collusion_ring",
    "case when cluster_size >= 5 then 'HIGH' else 'MEDIUM' end",
    "Loans packed into one place",
    "'Officer ' || officer_id || ' has ' || cluster_size || ' loans in one cell of coordinates'",
    "total",
    "officer_id",
    _GEO_KEY,
    "cluster_size",
)
_GEO_EVIDENCE = (
    "round(clat, 6) as center_latitude, round(clon, 6) as center_longitude, array_to_string(names, ', ') as borrowers"
)

_LATE_CTE = """
late as (select *, hour(created_at) as hr from loans where hour(created_at) >= 22 or hour(created_at) < 6),
late_officers as (
  select officer_id, count(loan_id) as loan_count, sum(amount) as total, arg_min(officer_name, loan_id) as officer_name,
    array_to_string(list(distinct hr order by hr), ',') as hours
  from late where officer_id is not null group by 1)"""

_LATE = _alert(
    "late_officers",
    "timing_anomaly",
    "case when loan_count < 5 then 'LOW' else 'MEDIUM' end",
    "Loans outside working hours",
    "officer_name || ' entered ' || loan_count || ' loans outside working hours'",
    "total * 0.05",
    "officer_id",
    "cast(officer_id as varchar)",
    "loan_count",
)

_GUARANTOR_CTE = """
backers as (
  select guarantor_name, count(loan_id) as loan_count, count(distinct borrower_id) as borrower_count,
    sum(amount) as total, arg_min(officer_id, loan_id) as officer_id,
    array_to_string(list(distinct officer_id order by officer_id) filter (where officer_id is not null), ',') as officers
  from loans where guarantor_name is not null group by 1 having count(loan_id) >= 3)"""

_GUARANTOR = _alert(
    "backers",
    "shared_guarantor",
    "case when loan_count < 5 then 'MEDIUM' else 'HIGH' end",
    "Guarantor of several loans",
    "guarantor_name || ' stands for ' || loan_count || ' loans of ' || borrower_count || ' borrowers'",
    "total * 0.2",
    "officer_id",
    "guarantor_name",
    "loan_count",
)

_STACK_CTE = """
stacked as (
  select borrower_id, count(loan_id) as loan_count, sum(amount) as total, arg_min(borrower_name, loan_id) as borrower_name,
    arg_min_null(officer_id, loan_id) as officer_id, count(distinct branch_name) as branch_count,
    array_to_string(list(distinct branch_name order by branch_name), ',') as branches,
    array_to_string(list(distinct officer_id order by officer_id) filter (where officer_id is not null), ',')
      as officers
  from loans where status = 'active' and borrower_id is not null group by 1 having count(loan_id) >= 2)"""

_STACK = _alert(
    "stacked",
    "loan_stacking",
    "case when branch_count > 1 then 'HIGH' else 'MEDIUM' end",
    "Several active loans",
    "borrower_name || ' holds ' || loan_count || ' active loans' ||"
    " case when branch_count > 1 then ' in ' || branch_count || ' branches' else '' end",
    "total",
    "officer_id",
    "cast(borrower_id as varchar)",
    "loan_count",
)

_ROWS_CTE = """
dup_phones as (
  select phone_number, count(*) as loan_count, coalesce(sum(amount), 0) as total,
    arg_min_null(officer_id, loan_id) as officer_id
  from loans where phone_number is not null and phone_number <> '' group by 1 having count(*) > 1)"""


def _rows(critical: bool) -> str:
    return _alert(
        "dup_phones",
        "GHOST_LOAN",
        "case when loan_count >= 4 then 'CRITICAL' else 'HIGH' end" if critical else "'HIGH'",
        "Phone number on several loans",
        "loan_count || ' loans carry phone number ' || phone_number",
        "total",
        "officer_id",
        "phone_number",
        "loan_count",
    )


_DAY_CTE = """
days as (
  select borrower_id, loan_date, count(*) as loan_count, coalesce(sum(amount), 0) as total,
    arg_min_null(officer_id, loan_id) as officer_id
  from loans where borrower_id is not null and loan_date is not null group by 1, 2 having count(*) > 1)"""

_DAY = _alert(
    "days",
    "LOAN_STACKING",
    "'HIGH'",
    "Several loans on one day",
    "loan_count || ' loans to one borrower on one day, UGX ' || cast(round(total) as bigint) || ' together'",
    "total",
    "officer_id",
    "cast(borrower_id as varchar) || '|' || cast(loan_date as varchar)",
    "loan_count",
)

_VOLUME_CTE = """
v1 as (
  select coalesce(cast(officer_id as varchar), 'Unknown') as officer_id,
    arg_min(coalesce(officer_name, cast(officer_id as varchar), 'Unknown'), loan_id) as name, count(*) as loan_count,
    sum(coalesce(amount, 0)) as total_amount
  from loans group by 1),
volumes as (
  select *, case when stddev_pop(loan_count) over () > 0
    then (loan_count - avg(loan_count) over ()) / stddev_pop(loan_count) over () else 0 end as z_score
  from v1),
busy as (select * from volumes where z_score > 2)"""

_VOLUME = _alert(
    "busy",
    "OFFICER_ANOMALY",
    "case when z_score > 3 then 'HIGH' else 'MEDIUM' end",
    "Officer with unusually many loans",
    "'Officer ' || name || ': ' || loan_count || ' loans, ' || printf('%.1f', z_score) || ' deviations above the mean'",
    "total_amount * 0.1",
    "officer_id",
    "officer_id",
    "loan_count",
)


def _late_loans_cte(condition: str) -> str:
    return f"""
timed as (select *, try_cast(split_part(approval_time, ':', 1) as int) as hr from loans),
late_loans as (select * from timed where {condition})"""


def _late_loan(alert_type: str) -> str:
    return _alert(
        "late_loans",
        alert_type,
        "'MEDIUM'",
        "Approved outside working hours",
        "'Approval of loan ' || coalesce(cast(loan_id as varchar), 'N/A') || ' at ' || approval_time",
        "coalesce(amount, 0)",
        "officer_id",
        "cast(loan_id as varchar)",
        "1",
    )


_AMOUNT_CTE = """
a1 as (select count(*) as n, avg(amount) as mean, stddev_pop(amount) as sd from loans where amount > 0),
outliers as (select loans.*, a1.* from loans, a1 where n >= 5 and amount > mean + 2.5 * sd)"""


def _amount(rounded: bool) -> str:
    percent = "round((amount/mean - 1) * 100)" if rounded else "trunc((amount/mean - 1) * 100)"
    return _alert(
        "outliers",
        "AMOUNT_ANOMALY",
        "'MEDIUM'",
        "Loan far above the usual amount",
        f"'UGX ' || cast(round(amount) as bigint) || ', ' || cast({percent} as int) || '% more than the mean'",
        "amount",
        "officer_id",
        "cast(loan_id as varchar)",
        "1",
    )


_SELF_CTE = """
own as (select * from loans where cast(officer_id as varchar) = cast(borrower_id as varchar))"""

_SELF = _alert(
    "own",
    "SELF_LENDING",
    "'CRITICAL'",
    "Officer is the borrower",
    "'Officer ' || officer_id || ' is the borrower of a loan they approved'",
    "coalesce(amount, 0)",
    "officer_id",
    "cast(loan_id as varchar)",
    "1",
)


def _share_cte(percent: float) -> str:
    return f"""
s1 as (
  select coalesce(cast(officer_id as varchar), 'Unknown') as officer_id, count(*) as loan_count,
    sum(coalesce(amount, 0)) as total from loans group by 1),
shares as (
  select * from (select *, loan_count * 100.0::double / sum(loan_count) over () as percentage from s1)
  where percentage > {percent} and loan_count > 10)"""


_SHARE = _alert(
    "shares",
    "OFFICER_CONCENTRATION",
    "'MEDIUM'",
    "Officer holds much of the book",
    "printf('%.1f', percentage) || '% of all loans (' || loan_count || ', worth UGX ' || cast(round(total) as bigint)"
    " || ') by officer ' || officer_id",
    "total",
    "officer_id",
    "officer_id",
    "loan_count",
)

_BACKEND_CTES = [_GHOST_CTE, _OFFICER_CTE, _GEO_CTE, _LATE_CTE, _GUARANTOR_CTE, _STACK_CTE]
_BACKEND = [_GHOST, _OFFICER, _GEO, _LATE, _GUARANTOR, _STACK]
_ENGINE_CTES = [_ROWS_CTE, _DAY_CTE, _VOLUME_CTE, _late_loans_cte("hr < 6 or hr >= 22"), _AMOUNT_CTE]
_ENGINE = [_rows(True), _DAY, _VOLUME, _late_loan("TIMING_ANOMALY"), _amount(False)]
_DEMO_CTES = [_ROWS_CTE, _DAY_CTE, _SELF_CTE, _late_loans_cte("hr < 7 or hr > 19"), _AMOUNT_CTE, _share_cte(40)]
_DEMO = [_rows(False), _DAY, _SELF, _late_loan("AFTER_HOURS"), _amount(True), _SHARE]


def _extended(alert: str, evidence: str) -> str:
    head, tail = alert.rsplit("\nfrom ", 1)
    return f"{head}, {evidence}\nfrom {tail}"


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


BACKEND_ALERTS = [*_BACKEND_CTES, "alerts as (" + _union(_BACKEND) + ")"]
ENGINE_ALERTS = [*_ENGINE_CTES, "alerts as (" + _union(_ENGINE) + ")"]

ORACLES: dict[str, str] = {
    "ghost_loans": _with(_GHOST_CTE) + _extended(_GHOST, _GHOST_EVIDENCE),
    "officer_anomaly": _with(_OFFICER_CTE) + _extended(_OFFICER, _OFFICER_EVIDENCE),
    "geo_clusters": _with(_GEO_CTE) + _extended(_GEO, _GEO_EVIDENCE),
    "after_hours_officer": _with(_LATE_CTE) + _extended(_LATE, "hours"),
    "shared_guarantor": _with(_GUARANTOR_CTE) + _extended(_GUARANTOR, "borrower_count, officers"),
    "stacking_active": _with(_STACK_CTE) + _extended(_STACK, "branches, officers"),
    "ghost_rows": _with(_ROWS_CTE) + _rows(True),
    "stacking_same_day": _with(_DAY_CTE) + _DAY,
    "officer_volume": _with(_VOLUME_CTE) + _extended(_VOLUME, "round(z_score, 6) as z_score"),
    "after_hours_loan": _with(_late_loans_cte("hr < 6 or hr >= 22")) + _late_loan("TIMING_ANOMALY"),
    "amount_outlier": _with(_AMOUNT_CTE)
    + _extended(_amount(False), "round(mean, 4) as mean, round(sd, 4) as std_dev"),
    "self_lending": _with(_SELF_CTE) + _SELF,
    "officer_concentration": _with(_share_cte(3)) + _extended(_SHARE, "round(percentage, 6) as percentage"),
    "all_alerts": _with(*_BACKEND_CTES) + _union(_BACKEND),
    "all_alerts_engine": _with(*_ENGINE_CTES) + _union(_ENGINE),
    "upload_no_id": _with(*ENGINE_ALERTS)
    + """select alert_type, severity, count(*) as alerts, count(*) as ids, round(sum(amount_at_risk), 2) as amount_at_risk
from alerts group by 1, 2""",
    "all_alerts_demo": _with(*_DEMO_CTES) + _union(_DEMO),
    "alert_members": _with(*BACKEND_ALERTS, """
keyed as (
  select 'ghost_loan' as alert_type, phone_number as entity_key, loan_id from loans
  union all select 'unusual_approval', cast(officer_id as varchar), loan_id from loans
  union all select 'collusion_ring', """ + _GEO_KEY + """, loan_id from c1
  union all select 'timing_anomaly', cast(officer_id as varchar), loan_id from late
  union all select 'shared_guarantor', guarantor_name, loan_id from loans
  union all select 'loan_stacking', cast(borrower_id as varchar), loan_id from loans where status = 'active')""")
    + "select alert_id, alert_type, entity_key, loan_id from keyed join alerts using (alert_type, entity_key)",
    "additive_score": _with() + """
select loan_id, least(round(0.1 + case when ratio > 3 then 0.3 else 0 end
  + case when hr < 6 or hr > 22 then 0.2 else 0 end
  + case when hr < 8 or hr >= 18 then 0.15 else 0 end
  + case when amount > 5000000 then 0.25 else 0 end, 2), 0.99) as score
from (select loan_id, amount, amount / (select avg(amount) from loans) as ratio,
        coalesce(hour(created_at), 12) as hr from loans)""",
}


# --- features ---------------------------------------------------------------------------------------------------

_AMOUNT_FEATURES = """
fa as (
  select loan_id, amount, ln(1 + amount) as amount_log,
    amount / (avg(amount) over (partition by product_id) + 1) as raw_product, product_id,
    amount / (avg(amount) over () + 1) as amount_vs_avg,
    (rank() over (order by amount) + (count(*) over (partition by amount) - 1) / 2.0::double)
      / count(*) over ()::double as amount_percentile,
    case when amount % 100000 = 0 then 1 else 0 end as is_round_amount
  from loans),
feat_amount as (
  select loan_id, amount, amount_log, case when product_id is null then 0 else raw_product end as amount_vs_product_avg,
    amount_vs_avg, amount_percentile, is_round_amount from fa)"""

_OFFICER_FEATURES = """
fo as (
  select officer_id, count(loan_id) as officer_loan_count, avg(amount) as officer_avg_amount,
    avg(case when status is distinct from 'rejected' then 1.0::double else 0 end) as officer_approval_rate
  from loans where officer_id is not null group by 1),
fos as (select avg(officer_loan_count) as m, stddev_samp(officer_loan_count) as s, count(*) as n from fo),
feat_officer as (
  select loan_id, coalesce(officer_loan_count, 0) as officer_loan_count,
    coalesce(officer_avg_amount, 0) as officer_avg_amount,
    case when n > 2 and s > 0 then coalesce((officer_loan_count - m) / s, 0) else 0 end as officer_volume_z,
    coalesce(officer_approval_rate, 0) as officer_approval_rate
  from loans left join fo using (officer_id), fos)"""

_TIME_FEATURES = """
ft as (select date_trunc('year', min(created_at))::date as y from loans),
feat_time as (
  select loan_id, coalesce(hour(created_at), 12) as hour,
    case when coalesce(hour(created_at), 12) < 6 or coalesce(hour(created_at), 12) >= 22 then 1 else 0 end
      as is_after_hours,
    coalesce(isodow(created_at) - 1, 0) as day_of_week,
    case when coalesce(isodow(created_at) - 1, 0) >= 5 then 1 else 0 end as is_weekend,
    coalesce(month(created_at), 1) as month, case when day(created_at) > 27 then 1 else 0 end as is_month_end,
    coalesce(date_diff('day', y, created_at::date), 0) as days_since_year_start
  from loans, ft)"""

_NETWORK_FEATURES = """
fp as (select phone_number, count(distinct borrower_id) as n from loans where phone_number is not null group by 1),
feat_network as (
  select loan_id, coalesce(fp.n, 0) as shared_phone_count, case when fp.n > 1 then 1 else 0 end as has_shared_phone,
    case when guarantor_name is null then 0 else count(loan_id) over (partition by guarantor_name) end
      as shared_guarantor_count,
    case when guarantor_name is not null and count(loan_id) over (partition by guarantor_name) > 2 then 1 else 0 end
      as has_shared_guarantor,
    case when national_id is null then 0 else count(loan_id) over (partition by national_id) end
      as national_id_loan_count
  from loans left join fp using (phone_number))"""

_GEO_FEATURES = """
feat_geo as (
  select loan_id,
    case when latitude is null or longitude is null then 0
      else count(loan_id) over (partition by round(latitude, 3), round(longitude, 3)) end as geographic_density,
    case when latitude is null or longitude is null or officer_id is null then 0
      else count(loan_id) over (partition by officer_id, round(latitude, 3), round(longitude, 3)) end
      as officer_geo_concentration
  from loans)"""

_BRANCH_FEATURES = """
feat_branch as (
  select loan_id, count(loan_id) over (partition by branch_id) as branch_loan_count,
    avg(amount) over (partition by branch_id) as branch_avg_amount,
    amount / (avg(amount) over (partition by branch_id) + 1) as amount_vs_branch_avg
  from loans)"""

_BORROWER_FEATURES = """
fb as (
  select borrower_id, count(loan_id) as n, sum(amount) as total, count(distinct branch_id) as branches,
    count(distinct officer_id) as officers from loans group by 1),
feat_borrower as (
  select loan_id, n as borrower_loan_count, case when n > 1 then 1 else 0 end as has_multiple_loans,
    total as borrower_total_exposure, branches as borrower_branch_count,
    case when branches > 1 then 1 else 0 end as multi_branch_borrower, officers as borrower_officer_count
  from loans join fb using (borrower_id))"""

FEATURE_CTES = [
    _AMOUNT_FEATURES,
    _OFFICER_FEATURES,
    _TIME_FEATURES,
    _NETWORK_FEATURES,
    _GEO_FEATURES,
    _BRANCH_FEATURES,
    _BORROWER_FEATURES,
    """
feats as (
  select * from feat_amount join feat_officer using (loan_id) join feat_time using (loan_id)
  join feat_network using (loan_id) join feat_geo using (loan_id) join feat_branch using (loan_id)
  join feat_borrower using (loan_id))""",
]

FEATURES = {
    "feat_amount": (
        _AMOUNT_FEATURES,
        "amount amount_log amount_vs_product_avg amount_vs_avg amount_percentile is_round_amount",
    ),
    "feat_officer": (
        _OFFICER_FEATURES,
        "officer_loan_count officer_avg_amount officer_volume_z officer_approval_rate",
    ),
    "feat_time": (
        _TIME_FEATURES,
        "hour is_after_hours day_of_week is_weekend month is_month_end days_since_year_start",
    ),
    "feat_network": (
        _NETWORK_FEATURES,
        "shared_phone_count has_shared_phone shared_guarantor_count has_shared_guarantor national_id_loan_count",
    ),
    "feat_geo": (_GEO_FEATURES, "geographic_density officer_geo_concentration"),
    "feat_branch": (_BRANCH_FEATURES, "branch_loan_count branch_avg_amount amount_vs_branch_avg"),
    "feat_borrower": (
        _BORROWER_FEATURES,
        "borrower_loan_count has_multiple_loans borrower_total_exposure borrower_branch_count"
        " multi_branch_borrower borrower_officer_count",
    ),
}


def _rounded(names: str) -> str:
    return ", ".join(f"round(cast({n} as double), 6) as {n}" for n in names.split())


_ALL_FEATURES = " ".join(names for _, names in FEATURES.values())

for _name, (_cte, _columns) in FEATURES.items():
    ORACLES[_name] = _with(_cte) + f"select loan_id, {_rounded(_columns)} from {_name}"

ORACLES["feature_matrix"] = _with(*FEATURE_CTES) + f"select loan_id, {_rounded(_ALL_FEATURES)} from feats"

ORACLES["feat_apply"] = _with("""
past as (select * from loans where loan_date < date '1998-01-01'),
po as (
  select officer_id, count(loan_id) as officer_loan_count, avg(amount) as officer_avg_amount
  from past where officer_id is not null group by 1),
pos as (select avg(officer_loan_count) as m, stddev_samp(officer_loan_count) as s, count(*) as n from po),
pb as (
  select branch_id, count(loan_id) as branch_loan_count, avg(amount) as branch_avg_amount from past
  where branch_id is not null group by 1)""") + """
select loan_id, coalesce(officer_loan_count, 0)::double as officer_loan_count,
  round(coalesce(officer_avg_amount, 0), 6) as officer_avg_amount,
  round(case when n > 2 and s > 0 then coalesce((officer_loan_count - m) / s, 0) else 0 end, 6) as officer_volume_z,
  coalesce(branch_loan_count, 0)::double as branch_loan_count,
  round(coalesce(branch_avg_amount, 0), 6) as branch_avg_amount,
  round(coalesce(amount / (branch_avg_amount + 1), 0), 6) as amount_vs_branch_avg
from loans left join po using (officer_id) left join pb using (branch_id), pos"""


# --- summaries --------------------------------------------------------------------------------------------------

_BOTH_ALERTS = [*_BACKEND_CTES, *_ENGINE_CTES, "alerts as (" + _union([*_BACKEND, *_ENGINE]) + ")"]
_PORTFOLIO = """
select count(*) as total_alerts, count(*) filter (where severity = 'CRITICAL') as critical_alerts,
  count(*) filter (where severity = 'HIGH') as high_alerts,
  count(*) filter (where severity = 'MEDIUM') as medium_alerts,
  count(*) filter (where severity is null or severity not in ('CRITICAL', 'HIGH', 'MEDIUM')) as low_alerts,
  cast(risk as int) as risk_score, round(sum(amount_at_risk), 2) as amount_at_risk,
  case when risk >= 70 then 'severe' when risk >= 40 then 'elevated' when risk >= 20 then 'guarded' else 'low' end
    as risk_band
from alerts, (select least(100, sum({points})) as risk from alerts) group by risk"""
_ENGINE_POINTS = "case severity when 'CRITICAL' then 25 when 'HIGH' then 15 when 'MEDIUM' then 8 else 3 end"
_BACKEND_POINTS = "case severity when 'HIGH' then 10 when 'MEDIUM' then 5 when 'LOW' then 2 else 1 end"
_MEMBER_FLAGS = """
members as (
  select distinct 'backend' as method, loan_id from (
    select loan_id from loans where phone_number in (select phone_number from ghosts)
    union all select loan_id from loans where officer_id in (select officer_id from odd_officers)
    union all select loan_id from c1 join cells using (officer_id, cell_lat, cell_lon)
    union all select loan_id from late where officer_id is not null
    union all select loan_id from loans where guarantor_name in (select guarantor_name from backers)
    union all select loan_id from loans where status = 'active' and borrower_id in (select borrower_id from stacked))
  union all
  select distinct 'engine', loan_id from (
    select loan_id from loans where phone_number in (select phone_number from dup_phones)
    union all select loan_id from loans join days using (borrower_id, loan_date)
    union all select loan_id from loans where coalesce(cast(officer_id as varchar), 'Unknown') in
      (select officer_id from busy)
    union all select loan_id from late_loans
    union all select loan_id from outliers))"""

ORACLES |= {
    "severity_counts": _with(*_BOTH_ALERTS) + "select severity, count(*) as alerts from alerts group by 1",
    "alert_types": _with(*_BOTH_ALERTS)
    + "select alert_type, replace(alert_type, '_', ' ') as label, count(*) as alerts from alerts group by 1",
    "portfolio_risk": _with(*ENGINE_ALERTS) + _PORTFOLIO.format(points=_ENGINE_POINTS),
    "portfolio_risk_backend": _with(*BACKEND_ALERTS) + _PORTFOLIO.format(points=_BACKEND_POINTS),
    "portfolio_risk_count": _with(*ENGINE_ALERTS) + _PORTFOLIO.format(points="10"),
    "alert_filter": _with(*BACKEND_ALERTS)
    + "select *, count(*) over () as total from alerts where severity = 'HIGH' and detection_method = 'rule'"
    " order by amount_at_risk desc, alert_id limit 50",
    "top_severe": _with(*ENGINE_ALERTS)
    + "select * from alerts where severity in ('CRITICAL', 'HIGH')"
    " order by severity, amount_at_risk desc, alert_id limit 5",
    "recent_alerts": _with(*BACKEND_ALERTS, """
keyed as (
  select 'ghost_loan' as alert_type, phone_number as entity_key, created_at from loans
  union all select 'unusual_approval', cast(officer_id as varchar), created_at from loans
  union all select 'collusion_ring', """ + _GEO_KEY + """, created_at from (select l.created_at, c1.* from c1 join loans l using (loan_id))
  union all select 'timing_anomaly', cast(officer_id as varchar), created_at from loans where hour(created_at) >= 22 or hour(created_at) < 6
  union all select 'shared_guarantor', guarantor_name, created_at from loans
  union all select 'loan_stacking', cast(borrower_id as varchar), created_at from loans where status = 'active'),
times as (select alert_type, entity_key, max(created_at) as created_at from keyed group by all)""")
    + "select a.*, created_at from alerts a left join times using (alert_type, entity_key) order by created_at desc nulls last, alert_id limit 10",
    "officer_ranking": _with(*BACKEND_ALERTS, """
ol as (select cast(officer_id as varchar) as officer_id, count(loan_id) as loan_count from loans
       where officer_id is not null group by 1),
oa as (select officer_id, count(*) as alert_count from alerts where officer_id is not null group by 1),
r as (select officer_id, loan_count, coalesce(alert_count, 0) as alert_count,
        coalesce(alert_count, 0)::double / loan_count * 100 as rate from ol left join oa using (officer_id))""")
    + """select officer_id, 'Officer ' || right(officer_id, 3) as name, loan_count, alert_count,
  round(rate, 1) as flag_rate, least(100, cast(trunc(rate * 8 + alert_count * 5) as bigint)) as risk_score
from r order by risk_score desc, officer_id limit 10""",
    "officer_ranking_engine": _with(*ENGINE_ALERTS, """
oa as (select officer_id, count(*) as alert_count from alerts where officer_id is not null group by 1),
r as (select *, least(100, coalesce(alert_count, 0) * 10 + case when z_score > 2 then 30 else 0 end) as risk
      from volumes left join oa using (officer_id))""")
    + """select officer_id, name, loan_count, total_amount, round(z_score, 6) as z_score,
  coalesce(alert_count, 0) as alert_count, cast(risk as bigint) as risk_score,
  case when risk > 60 then 'high' when risk > 30 then 'medium' else 'low' end as risk_band from r""",
    "risk_distribution": _with(*FEATURE_CTES, """
scored as (select least(greatest(officer_approval_rate * 30 + amount_vs_avg * 20 + is_after_hours * 25
  + shared_phone_count * 25, 0), 100) as s from feats),
bins as (select * from (values (0, 20, '0-20', 'Very Low'), (20, 40, '21-40', 'Low'), (40, 60, '41-60', 'Medium'),
  (60, 80, '61-80', 'High'), (80, 1000, '81-100', 'Critical')) t(lo, hi, "range", label))""")
    + """select "range", label, (select count(*) from scored where s <= hi and (s > lo or lo = 0)) as loans from bins""",
    "portfolio_summary": _with() + """
select count(*) as total_loans, sum(amount) as total_amount, count(distinct officer_id) as officers,
  count(distinct branch_id) as branches, min(loan_date) as first_date, max(loan_date) as last_date from loans""",
    "label_summary": _with(_AMOUNT_CTE, _SELF_CTE, """
labelled as (
  select loan_id, case when loan_id in (select loan_id from own) then 'self_lending'
    when loan_id in (select loan_id from outliers) then 'amount' end as fraud_type from loans)""") + """
select null as fraud_type, count(fraud_type) as loans,
  round(avg(case when fraud_type is null then 0.0::double else 1 end), 6) as rate
from labelled
union all
select fraud_type, count(*), null from labelled where fraud_type is not null group by 1""",
    "timeline": _with(*_BACKEND_CTES, *_ENGINE_CTES, _MEMBER_FLAGS, """
per_loan as (
  select cast(date_trunc('month', loan_date) as date) as month, loan_id, max((method = 'backend')::int) as b,
    max((method = 'engine')::int) as e from members join loans using (loan_id) group by 1, 2)""")
    + "select month, sum(b)::bigint as backend, sum(e)::bigint as engine, sum(b * e)::bigint as combined"
    " from per_loan group by 1",
    "feature_corr": _with(*FEATURE_CTES, """
lab as (select loan_id, (amount > (select avg(amount) + 2.5 * stddev_pop(amount) from loans))::int as y from loans),
cors as (""" + " union all ".join(
        f"select '{n}' as feature, corr({n}, y) as correlation from feats join lab using (loan_id)"
        for n in _ALL_FEATURES.split()
    ) + """)""")
    + """select feature, round(correlation, 6) as correlation from cors
where correlation is not null and not isnan(correlation) order by abs(correlation) desc, feature limit 10""",
    "feature_summary": _with(*FEATURE_CTES) + " union all ".join(
        f"select '{n}' as feature, count({n})::double as n, round(avg({n}), 4) as mean, round(stddev_samp({n}), 4) as sd,"
        f" round(min({n})::double, 4) as minimum, round(quantile_cont({n}::double, 0.25), 4) as q1,"
        f" round(quantile_cont({n}::double, 0.5), 4) as median, round(quantile_cont({n}::double, 0.75), 4) as q3,"
        f" round(max({n})::double, 4) as maximum from feats"
        for n in _ALL_FEATURES.split()
    ),
    "score_statistics": _with() + """
, o as (select amount, row_number() over (order by amount) - 1 as i, count(*) over () as c from loans)
select count(*) as n, round(avg(amount), 4) as mean, min(amount) as minimum, max(amount) as maximum,
  max(case when i = floor(c * 0.5) then amount end) as median, max(case when i = floor(c * 0.95) then amount end) as p95
from o""",
    "weekly_top": _with(*ENGINE_ALERTS[:-1], """
flat as (
  select a.*, l.branch_name as institution, cast(date_trunc('week', l.loan_date) as date) as week
  from (""" + _union([_late_loan("TIMING_ANOMALY"), _amount(False)]) + """) a
  join loans l on cast(l.loan_id as varchar) = a.entity_key)""") + """
select alert_id, institution, week, amount_at_risk, rank from (
  select *, row_number() over (partition by institution, week order by amount_at_risk desc, alert_id) as rank from flat)
where rank <= 10""",
    "alert_precision": _with(*_BACKEND_CTES, """
flags as (
  select distinct alert_type, loan_id from (
    select 'ghost_loan' as alert_type, loan_id from loans where phone_number in (select phone_number from ghosts)
    union all select 'unusual_approval', loan_id from loans where officer_id in (select officer_id from odd_officers)
    union all select 'collusion_ring', loan_id from c1 join cells using (officer_id, cell_lat, cell_lon)
    union all select 'timing_anomaly', loan_id from late where officer_id is not null
    union all select 'shared_guarantor', loan_id from loans where guarantor_name in (select guarantor_name from backers)
    union all select 'loan_stacking', loan_id from loans
      where status = 'active' and borrower_id in (select borrower_id from stacked))),
outcomes as (select doc_id as loan_id, toxic = 1 as confirmed from labels)""") + """
select alert_type, count(*) as judged, count(*) filter (where confirmed) as confirmed,
  round(count(*) filter (where confirmed) / count(*)::double, 6) as precision,
  round(count(*) filter (where confirmed) / nullif((select count(*) from outcomes where confirmed), 0)::double, 6)
    as recall
from flags join outcomes using (loan_id) group by 1""",
    "behaviour_monthly": _with() + """
, m as (
  select cast(date_trunc('month', loan_date) as date) as month, *, hour(created_at) < 6 or hour(created_at) >= 22 as late
  from loans),
pm as (select month, officer_id, count(*) as n from m where officer_id is not null group by 1, 2),
top as (select month, max(n) as busiest from pm group by 1)
select month, count(*) as loans,
  round(count(*) filter (where late) / nullif(count(created_at), 0)::double, 6) as after_hours_share,
  round(count(*) filter (where amount % 100000 = 0) / count(*)::double, 6) as round_amount_share,
  round(max(busiest) / count(*)::double, 6) as officer_concentration
from m left join top using (month) group by month""",
}


# --- transaction history ----------------------------------------------------------------------------------------

_CATEGORIES = (
    "retail 0.1 grocery 0.15 restaurant 0.2 gas 0.25 travel 0.4 entertainment 0.35 utilities 0.1 healthcare 0.15"
    " education 0.1 transfer 0.5 withdrawal 0.45 online 0.55 foreign 0.7 gambling 0.8 crypto 0.75 unknown 0.3"
).split()
_WEIGHTS = ", ".join(_CATEGORIES[1::2])

_TRANSACTIONS = f"""
with e as (
  select user_id, event_id, ts, cast(floor(epoch_us(ts) / 1e6) as bigint) as s, value, event_type,
    cast(json_extract_string(props, '$.k') as int) as k from events),
pairs as (
  select a.event_id, count(b.event_id) as c30, avg(b.value) as a30,
    count(case when b.s >= a.s - 86400 and b.event_type = 'error' then 1 end) as f24,
    count(distinct case when b.s >= a.s - 7*86400 then b.event_type end) as u7
  from e a left join e b on a.user_id = b.user_id and b.s >= a.s - 30*86400 and b.s < a.s group by 1),
prev as (
  select *, lag(s) over w as ps, lag(k) over w as pk, min(s) over (partition by user_id) as s0
  from e window w as (partition by user_id order by ts, event_id)),
linked as (
  select event_id, user_id, ts, value, k, cast(floor(s/86400.0) - floor(s0/86400.0) as bigint) as customer_age_days,
    (s - ps) / 60.0::double as minutes_since_prev, pk%3 = k%3 as same_device,
    2 * 6371.0::double * asin(sqrt(least(1.0::double, pow(sin(radians(k*0.01::double - pk*0.01::double)/2), 2)
      + cos(radians(pk*0.01::double)) * cos(radians(k*0.01::double))
        * pow(sin(radians(k*0.02::double - pk*0.02::double)/2), 2)))) as distance_from_prev
  from prev),
base as (
  select event_id as transaction_id, value as amount, coalesce(nullif(a30, 0), value) as avg_amount_30d, hour(ts) as hour,
    isodow(ts) - 1 as day_of_week, customer_age_days as age, c30, f24, u7, minutes_since_prev as mins,
    distance_from_prev as dist, same_device, [{_WEIGHTS}][k % 16 + 1] as merchant_category
  from linked join pairs using (event_id)),
vectors as (
  select transaction_id, amount::double as amount,
    amount / coalesce(nullif(avg_amount_30d, 0), 1) as amount_ratio, hour::double as hour,
    day_of_week::double as day_of_week, (day_of_week >= 5)::int::double as is_weekend,
    (hour < 8 or hour >= 18)::int::double as is_after_hours,
    coalesce(nullif(age, 0), 365)::double as customer_age_days,
    coalesce(nullif(c30, 0), 10)::double as transaction_count_30d, avg_amount_30d,
    merchant_category::double as merchant_category, coalesce(same_device::int, 0)::double as same_device,
    coalesce(dist, 0)::double as distance_from_prev, coalesce(nullif(mins, 0), 60)::double as minutes_since_prev,
    coalesce(f24, 0)::double as failed_attempts_24h, coalesce(nullif(u7, 0), 5)::double as unique_merchants_7d
  from base)
"""

_STORED = [
    ("amount", 500000, 1000000),
    ("amount_ratio", 1, 2),
    ("hour", 12, 6),
    ("day_of_week", 2.5, 2),
    ("is_weekend", 0.28, 0.45),
    ("is_after_hours", 0.25, 0.43),
    ("customer_age_days", 365, 300),
    ("transaction_count_30d", 15, 10),
    ("avg_amount_30d", 500000, 800000),
    ("merchant_category", 0.3, 0.25),
    ("same_device", 0.8, 0.4),
    ("distance_from_prev", 5, 20),
    ("minutes_since_prev", 60, 120),
    ("failed_attempts_24h", 0.1, 0.5),
    ("unique_merchants_7d", 5, 4),
]

ORACLES |= {
    "hist_30d": _TRANSACTIONS + "select event_id as transaction_id, c30::double as transaction_count_30d,"
    " round(a30, 10) as avg_amount_30d from pairs",
    "hist_fail24": _TRANSACTIONS
    + "select event_id as transaction_id, f24::double as failed_attempts_24h from pairs",
    "hist_uniq7": _TRANSACTIONS + "select event_id as transaction_id, u7::double as unique_merchants_7d from pairs",
    "hist_prev": _TRANSACTIONS + "select event_id as transaction_id, customer_age_days, same_device,"
    " round(minutes_since_prev, 4) as minutes_since_prev, round(distance_from_prev, 4) as distance_from_prev from linked",
    "vector15": _TRANSACTIONS
    + "select transaction_id, "
    + ", ".join(f"round({n}, 10) as {n}" for n, _, _ in _STORED)
    + " from vectors",
    "vector15_normalised": _TRANSACTIONS
    + "select transaction_id, "
    + ", ".join(f"(({n} - {m}::double) / {s}::double)::float::double as {n}" for n, m, s in _STORED)
    + " from vectors",
    "last7": """
with w as (
  select user_id, event_id, list(event_id) over f as ids, list(value) over f as amounts
  from events window f as (partition by user_id order by ts, event_id rows between 6 preceding and current row))
select user_id as customer, event_id as transaction_id,
  repeat('-,', cast(7 - len(ids) as int)) || array_to_string(ids, ',') as sequence,
  round(list_sum(amounts), 4) as sequence_amount from w""",
}

# Steps of a sequence that do not exist have the features of an empty transaction.
_EMPTY = {"hour": 12, "day_of_week": 2, "customer_age_days": 365, "transaction_count_30d": 10, "merchant_category": 0.3,
          "minutes_since_prev": 60, "unique_merchants_7d": 5}
_NO_PAST = {"amount_ratio": "case when amount = 0 then 0 else 1 end", "avg_amount_30d": "amount", "customer_age_days": "365",
            "transaction_count_30d": "10", "same_device": "0", "distance_from_prev": "0", "minutes_since_prev": "60",
            "failed_attempts_24h": "0", "unique_merchants_7d": "5"}


def _sequence(past: bool) -> str:
    steps = ", ".join(
        f"round(sum((7 - back) * v.{n}) + any_value(empty) * {_EMPTY.get(n, 0)}::double, 6) as {n}" for n, _, _ in _STORED
    )
    chosen = ", ".join(f"({n if past else _NO_PAST.get(n, n)})::double as {n}" for n, _, _ in _STORED)
    return f"""{_TRANSACTIONS}, chosen as (select transaction_id, {chosen} from vectors),
placed as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as k from e),
steps as (
  select p.user_id as customer, p.event_id as transaction_id, p.k - q.k as back, q.event_id as step,
    greatest(7 - p.k, 0) * (greatest(7 - p.k, 0) + 1) / 2 as empty
  from placed p join placed q on q.user_id = p.user_id and q.k between p.k - 6 and p.k)
select s.customer, s.transaction_id, {steps}
from steps s join chosen v on v.transaction_id = s.step group by s.customer, s.transaction_id"""


ORACLES |= {"sequence15": _sequence(True), "sequence15_plain": _sequence(False)}


ORACLES["stream_vector15"] = ORACLES["vector15"]


# --- schema mapping ---------------------------------------------------------------------------------------------

_LAYOUTS = {
    "upper": {
        "LOAN_REF": "'MCU-' || lpad(cast(loan_id as varchar), 9, '0')",
        "CUSTOMER_ID": "'CU' || borrower_id",
        "CUSTOMER_NAME": "upper(borrower_name)",
        "PHONE_NUMBER": "'256' || substr(phone_number, 2)",
        "PRINCIPAL_AMOUNT": "cast(cast(amount as bigint) as varchar)",
        "ISSUE_DATE": "cast(loan_date as varchar)",
        "APPROVAL_TIME": "approval_time",
        "EMPLOYEE_ID": "'EMP' || officer_id",
        "BRANCH_CODE": "branch_name",
        "LOAN_STATE": "upper(status)",
    },
    "mixed": {
        "loanId": "'GDM' || loan_id",
        "clientId": "'GC' || borrower_id",
        "Client Name": "borrower_name",
        "telephone": "substr(phone_number, 1, 3) || '-' || substr(phone_number, 4, 3) || '-' || substr(phone_number, 7)",
        "loan_amount": "format('{:,}', cast(amount as bigint))",
        "Disbursement Date": "strftime(loan_date, '%d-%b-%y')",
        "time": "substr(approval_time, 1, 5)",
        "approvedBy": "'Officer ' || officer_id",
        "branch location": "branch_name",
        "Status": "status",
    },
    "short": {
        "id": "'W' || loan_id",
        "mid": "'M' || borrower_id",
        "name": "borrower_name",
        "mob": "phone_number",
        "amt": "cast(cast(amount as bigint) as varchar)",
        "dt": "strftime(loan_date, '%d/%m/%Y')",
        "tm": "substr(approval_time, 1, 5)",
        "stf": "'S' || officer_id",
        "br": "branch_name",
        "st": "upper(substr(status, 1, 1))",
        "qx": "regexp_extract(guarantor_name, '^(.*) Brand', 1)",
        "qz": "status",
    },
}

_CELLS = (
    "cells as (select * from ("
    + " union all ".join(
        f"select '{source}' as source, {place} as position, '{column}' as \"column\", loan_id as row, {value} as value"
        " from loans"
        for source, columns in _LAYOUTS.items()
        for place, (column, value) in enumerate(columns.items())
    )
    + ") where value is not null and trim(value) <> '')"
)

_PATTERNS = {
    "phone": r"^\+?256\d{9}$|^0\d{9}$|^\+?\d{10,15}$|^07\d{8}$|^256\d{9}$",
    "national_id": r"^[A-Z]{2}\d{13}[A-Z0-9]$|^CF\d{13}[A-Z]$|^CM\d{13}[A-Z]$|^\d{14}$",
    "date": r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$|^\d{2}-\d{2}-\d{4}$|^\d{4}/\d{2}/\d{2}$",
    "time": r"^\d{2}:\d{2}(:\d{2})?$",
    "amount": r"^\d{1,3}(,\d{3})*(\.\d{2})?$|^\d+\.?\d*$",
    "email": r"^[\w\.-]+@[\w\.-]+\.\w+$",
}
_STATUS = "active inactive paid closed pending approved rejected defaulted completed disbursed overdue".split()
_STATUS_ANY = [*_STATUS, "written_off"]


def _share_of(test: str) -> str:
    return f"avg(case when {test} then 1.0::double else 0 end)"


_CLEAN = "translate(value, ' -()', '')"
_DIGITS = "len(regexp_extract_all({0}, '[0-9]'))"
_MEASURES = {
    "values": "count(*)",
    "distinct_values": "count(distinct value)",
    "mean_length": "avg(length(value))",
    "first_length": "arg_min(length(value), row)",
    "numeric_share": _share_of("try_cast(value as double) is not null"),
    "integer_share": _share_of(r"regexp_matches(value, '^-?\d+$')"),
    "fine_share": _share_of(r"length(regexp_extract(value, '\.(\d*)$', 1)) > 4"),
    "number_min": "min(try_cast(value as double))",
    "number_max": "max(try_cast(value as double))",
    "number_mean": "avg(try_cast(value as double))",
    "plain_share": _share_of("try_cast(replace(value, ',', '') as double) is not null"),
    "plain_min": "min(try_cast(replace(value, ',', '') as double))",
    "plain_max": "max(try_cast(replace(value, ',', '') as double))",
    "plain_mean": "avg(try_cast(replace(value, ',', '') as double))",
    "date_share": _share_of(
        "try_strptime(trim(value), ['%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y', '%Y/%m/%d', '%d-%b-%y']) is not null"
    ),
    "name_share": _share_of(
        r"regexp_matches(value, '^\s*[''-]*\p{L}[\p{L}''-]*(\s+[''-]*\p{L}[\p{L}''-]*){1,3}\s*$')"
    ),
    "two_word_share": _share_of(r"regexp_matches(value, '^[A-Za-z]+\s+[A-Za-z]+')"),
    "alpha_share": _share_of(r"regexp_matches(value, '^\s*[\p{L}''-]+(\s+[\p{L}''-]+)+\s*$')"),
    "has_status": "bool_or(lower(value) in (" + ", ".join(f"'{w}'" for w in _STATUS_ANY) + "))",
    "status_share": _share_of("regexp_matches(lower(value), '" + "|".join(_STATUS) + "')"),
    "b_phone": _share_of(f"length({_CLEAN}) between 10 and 15 and {_DIGITS.format(_CLEAN)} >= 9"),
    "b_date": _share_of(f"contains(value, '-') and length(value) between 8 and 10 and {_DIGITS.format('value')} >= 6"),
    "b_time": _share_of(f"contains(value, ':') and length(value) between 4 and 8 and {_DIGITS.format('value')} >= 3"),
    **{f"p_{k}": _share_of(f"regexp_matches(trim(value), '{p}')") for k, p in _PATTERNS.items()},
    "e_phone": _share_of(rf"regexp_matches({_CLEAN}, '^(\+?256|0)?[0-9]{{9}}$')"),
    "e_nin": _share_of(r"regexp_matches(translate(upper(value), ' -', ''), '^[A-Z]{2}\d{13}[A-Z0-9]$')"),
    "e_date": _share_of(r"regexp_matches(value, '^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$')"),
    "e_time": _share_of(r"regexp_matches(value, '^\d{2}:\d{2}(:\d{2})?$')"),
    "e_commas": _share_of(r"regexp_matches(value, '^\d{1,3}(,\d{3})+(\.\d{2})?$')"),
}
_NOT_ROUNDED = {"values", "distinct_values", "first_length", "has_status"}


def _profile(source: str = "cells") -> str:
    measures = ", ".join(f'{m} as "{n}"' for n, m in _MEASURES.items())
    return f'profiles as (select source, position, "column", {measures} from {source} group by 1, 2, 3)'


def _variations() -> dict[str, list[str]]:
    from ledgerlens.operators.mapping import name_variations

    return name_variations()


def _known_names(extended: bool) -> str:
    known = _variations()
    if not extended:
        core = (
            "loan_id borrower_id borrower_name phone national_id amount loan_date approval_time officer_id officer_name"
            " branch status"
        ).split()
        known = {f: known[f] for f in core}
    rows = [(f, n) for f, names in known.items() for n in names]
    values = ", ".join(f"('{f}', '{n}', {i})" for i, (f, n) in enumerate(rows))
    return f"known as (select * from (values {values}) t(field, name, place))"


def _best_names(headers: str, header: str) -> str:
    """CTEs matched(header, field, score): the best field of each header of the CTE or table expression `headers`."""
    return f"""
scored as (
  select h.header, field, place, case when clean = name then 1.0::double else greatest(
      case when contains(clean, name) or contains(name, clean) then 0.85 else 0 end,
      (greatest(length(clean), length(name)) - levenshtein(clean, name)) / greatest(length(clean), length(name))::double)
    end as score
  from (select header, {header} as clean from {headers}) h, known),
matched as (
  select header, field, score from (
    select *, row_number() over (partition by header order by score desc, place) as rn from scored) where rn = 1)"""


_CLEAN_HEADER = "translate(trim(lower(header)), ' -', '__')"

_DETECT = """
patterned as (
  select *, greatest(p_phone, p_national_id, p_date, p_time, p_amount, p_email) as p_best,
    case greatest(p_phone, p_national_id, p_date, p_time, p_amount, p_email)
      when p_phone then 'phone' when p_national_id then 'national_id' when p_date then 'loan_date'
      when p_time then 'approval_time' when p_amount then 'amount' else 'email' end as p_field,
    case
      when numeric_share > 0.9 and number_min >= 0 and number_mean > 10000 then 'amount:0.75'
      when numeric_share > 0.9 and number_min >= 0 and number_max <= 100 then 'interest_rate:0.6'
      when numeric_share > 0.9 and number_min >= 1 and number_max <= 360 and integer_share = 1 then 'term_months:0.6'
      when numeric_share > 0.9 and number_min >= -90 and number_max <= 90 and fine_share > 0.5 then 'latitude:0.65'
      when numeric_share > 0.9 and number_min >= -180 and number_max <= 180 and fine_share > 0.5 then 'longitude:0.65'
      when date_share > 0.8 then 'loan_date:0.7'
      when distinct_values / "values"::double > 0.95 and mean_length < 15 then 'loan_id:0.6'
      when distinct_values / "values"::double > 0.95 and mean_length < 25 then 'borrower_id:0.55'
      when name_share > 0.7 then 'borrower_name:0.7'
      when has_status then 'status:0.8' end as guess
  from profiles),
candidates as (
  select source, position, "column",
    case when score > 0.8 then field when p_best > 0.7 then p_field
      when cast(split_part(guess, ':', 2) as double) > 0.6 then split_part(guess, ':', 1)
      when score > 0.5 then field end as standard,
    case when score > 0.8 then score when p_best > 0.7 then p_best
      when cast(split_part(guess, ':', 2) as double) > 0.6 then cast(split_part(guess, ':', 2) as double)
      when score > 0.5 then score end as confidence,
    case when score > 0.8 then 'name_matching' when p_best > 0.7 then 'pattern_detection'
      when cast(split_part(guess, ':', 2) as double) > 0.6 then 'statistical_analysis'
      when score > 0.5 then 'name_matching_low' end as method
  from patterned join matched on header = "column")"""

_RESOLVE = """
ranked as (
  select *, row_number() over (partition by source, standard order by confidence desc, position) as rn from candidates),
resolved as (
  select source, position, "column", case when rn = 1 then standard end as standard,
    case when rn = 1 and standard is not null then confidence end as confidence,
    case when rn = 1 and standard is not null then method end as method
  from ranked)"""

_HEADERS = 'headers as (select distinct "column" as header from cells)'


def _mapped(profile_of: str = "cells", *extra: str) -> str:
    return _with(
        _CELLS, *extra, _profile(profile_of), _known_names(True), _HEADERS, _best_names("headers", _CLEAN_HEADER),
        _DETECT, _RESOLVE,
    )


_SAMPLE = """
sampled as (
  select * exclude (rn) from (
    select *, row_number() over (partition by source, position order by row) as rn from cells) where rn <= 100)"""
_RESOLVED = 'select source, position, "column", standard, round(confidence, 6) as confidence, method from '

_ENGINE_DETECT = """
scored as (
  select h.header, field, place,
    case when clean = name then 100 else greatest(
      case when contains(clean, name) or contains(name, clean) then 85 else 0 end,
      case when sim > 0.7 then cast(floor(sim * 100) as int) else 0 end) end as score,
    case when clean = name then 'exact_match'
      when case when contains(clean, name) or contains(name, clean) then 85 else 0 end
        >= case when sim > 0.7 then cast(floor(sim * 100) as int) else 0 end then 'name_match'
      else 'fuzzy_match' end as method
  from (select header, clean, field, name, place, (greatest(length(clean), length(name)) - levenshtein(clean, name))
          / greatest(length(clean), length(name))::double as sim
        from (select header, regexp_replace(lower(header), '[^a-z0-9]', '_', 'g') as clean from headers), known) h),
matched as (
  select header, field, score, method from (
    select *, row_number() over (partition by header order by score desc, place) as rn from scored where score > 0)
  where rn = 1),
looked as (
  select *, case when e_phone > 0.7 then 'phone:90' when e_nin > 0.7 then 'national_id:92'
      when e_date > 0.7 then 'loan_date:85' when e_time > 0.7 then 'approval_time:80'
      when e_commas > 0.7 then 'amount:85' end as pat,
    case when plain_share > 0.9 and plain_min >= 0 and plain_mean > 100000 then 'amount:75'
      when plain_share > 0.9 and plain_min >= 0 and plain_max <= 100 and plain_mean < 50 then 'interest_rate:60'
      when plain_share > 0.9 and plain_min >= 1 and plain_max <= 360 then 'term_months:55'
      when distinct_values / "values"::double > 0.95 and first_length < 15 then 'loan_id:60'
      when two_word_share > 0.7 then 'borrower_name:70' when status_share > 0.5 then 'status:80' end as st
  from profiles left join matched on header = "column"),
chosen as (
  select source, position, "column",
    case when coalesce(score, 0) = 100 then field || ':100:exact_match'
      when cast(split_part(pat, ':', 2) as int) > coalesce(score, 0) then pat || ':pattern'
      when score > 0 then field || ':' || score || ':' || method
      when st is not null then st || ':statistics' end as pick
  from looked),
candidates as (
  select source, position, "column", split_part(pick, ':', 1) as standard,
    cast(split_part(pick, ':', 2) as int) as confidence, split_part(pick, ':', 3) as method
  from chosen where cast(split_part(pick, ':', 2) as int) > 40
  union all
  select source, position, "column", null, null, null from chosen
  where pick is null or cast(split_part(pick, ':', 2) as int) <= 40)"""

_TEXTS = " union all ".join(
    f"select {c} as header from {t}"
    for t, c in [
        ("customer", "c_name"),
        ("customer", "c_mktsegment"),
        ("supplier", "s_name"),
        ("part", "p_name"),
        ("part", "p_type"),
        ("nation", "n_name"),
        ("events", "event_type"),
        ("orders", "o_orderpriority"),
    ]
)

_REQUIRED = "loan_id borrower_id amount officer_id".split()
_IMPORTANT = "phone loan_date borrower_name branch status".split()


def _found(fields: list[str]) -> str:
    items = ", ".join(f"case when list_contains(fs, '{f}') then '{f}' end" for f in fields)
    return f"array_to_string(list_filter([{items}], lambda x: x is not null), ',')"


ORACLES |= {
    "column_sample": _with(_CELLS, _SAMPLE) + 'select source, position, "column", row, value from sampled',
    "column_profile": _with(_CELLS, _profile())
    + 'select source, position, "column", '
    + ", ".join(f'"{n}"' if n in _NOT_ROUNDED else f"round({n}, 6) as {n}" for n in _MEASURES)
    + " from profiles",
    "name_match": "with " + _known_names(True) + ", headers as (select distinct header from (" + _TEXTS + ") "
    "where header is not null)," + _best_names("headers", _CLEAN_HEADER)
    + " select header, field, round(score, 6) as score from matched",
    "similarity": """
select p_partkey,
  round((greatest(length(p_name), length(p_type)) - levenshtein(p_name, lower(p_type)))
    / greatest(length(p_name), length(p_type))::double, 6) as name_type,
  round((greatest(length(p_type), length(p_brand)) - levenshtein(p_type, p_brand))
    / greatest(length(p_type), length(p_brand))::double, 6) as type_brand
from part""",
    "mapping_detect": _mapped() + _RESOLVED + "candidates",
    "mapping_resolve": _mapped() + _RESOLVED + "resolved",
    "mapping_sampled": _mapped("sampled", _SAMPLE) + _RESOLVED + "resolved",
    "mapping_engine": _with(_CELLS, _profile(), _known_names(False), _HEADERS, _ENGINE_DETECT, _RESOLVE)
    + 'select source, position, "column", standard, confidence, method from resolved',
    "mapping_report": _mapped()
    + f"""select source, total_columns, mapped_columns, unmapped_columns, methods, mappings,
  (select string_agg(method || ':' || n, ',' order by method) from (
     select r.method, count(*) as n from resolved r where r.source = s.source and r.method is not null group by 1)) as method_histogram,
  {_found(_REQUIRED)} as required_found,
  {_found(_IMPORTANT)} as important_found,
  list_contains(fs, 'borrower_id') and list_contains(fs, 'amount') as can_analyze
from (
  select source, count(*) as total_columns, count(standard) as mapped_columns,
    count(*) - count(standard) as unmapped_columns,
    array_to_string(list(method order by method) filter (where method is not null), ',') as methods,
    string_agg("column" || '=' || standard, ',' order by "column" || '=' || standard) as mappings,
    list(standard) filter (where standard is not null) as fs
  from resolved group by source) s""",
    "semantic_top1": """
with x as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
refs as (select label as name, i, avg(v) as m from x group by 1, 2),
sizes as (select name, sqrt(sum(m * m)) as s from refs group by 1),
dots as (
  select x.vec_id, any_value(x.label) as label, refs.name, sum(x.v * refs.m) as dot, sqrt(sum(x.v * x.v)) as own
  from x join refs using (i) group by x.vec_id, refs.name),
best as (
  select *, row_number() over (partition by vec_id order by dot / (own * s) desc, name desc) as rn
  from dots join sizes using (name))
select vec_id, label, name as match, round(dot / (own * s), 6) as score from best where rn = 1""",
    "union_sources": _with() + """
select 'upper' as source, 'MCU-' || lpad(cast(loan_id as varchar), 9, '0') as loan_id, 'CU' || borrower_id as borrower_id,
  '256' || substr(phone_number, 2) as phone_number, amount, loan_date, approval_time, 'EMP' || officer_id as officer_id,
  coalesce('EMP' || officer_id, 'Unknown') as officer_name, branch_name, status, hour(created_at) as created_hour
from loans
union all
select 'mixed', 'GDM' || loan_id, 'GC' || borrower_id, phone_number, amount, loan_date, substr(approval_time, 1, 5),
  'Officer ' || officer_id, coalesce('Officer ' || officer_id, 'Unknown'), branch_name, status, hour(created_at) from loans
union all
select 'short', 'W' || loan_id, 'M' || borrower_id, phone_number, amount, loan_date, substr(approval_time, 1, 5),
  'S' || officer_id, coalesce('S' || officer_id, 'Unknown'), branch_name,
  status, hour(created_at) from loans""",
}


# --- graph ------------------------------------------------------------------------------------------------------

_LABELLED = """
lab as (
  select *, amount > (select avg(amount) + 2.5 * stddev_pop(amount) from loans where amount > 0)
      or coalesce(officer_id = borrower_id, false) as is_fraud
  from loans),
hubs as (
  select phone_number, min(borrower_id) as hub from loans where phone_number is not null and borrower_id is not null
  group by 1 having count(distinct borrower_id) > 1),
big_backers as (
  select guarantor_name, count(*) as n from loans where guarantor_name is not null and borrower_id is not null
  group by 1 having count(*) >= 3),
all_nodes as (
  select 'O:' || officer_id as id, coalesce(arg_min(officer_name, loan_id), cast(officer_id as varchar)) as name,
    'officer' as type, case when count(*) > 50 then 'high' else 'low' end as risk, count(*) as loan_count,
    null::double as amount
  from lab where officer_id is not null group by officer_id
  union all
  select 'B:' || borrower_id, arg_min(borrower_name, loan_id), 'borrower',
    case when bool_or(is_fraud) then 'high' when bool_or(hub is not null) then 'medium' else 'low' end, count(*),
    arg_min(amount, loan_id)
  from lab left join hubs using (phone_number) where borrower_id is not null group by borrower_id
  union all
  select 'G:' || sha256(guarantor_name), substr(guarantor_name, 1, 20), 'guarantor', 'high', n, null from big_backers),
all_edges as (
  select 'O:' || officer_id as source, 'B:' || borrower_id as target, 'approved' as type,
    borrower_id in (select borrower_id from lab where is_fraud) as suspicious
  from lab where officer_id is not null and borrower_id is not null group by officer_id, borrower_id
  union all
  select distinct 'B:' || hub, 'B:' || borrower_id, 'shared_phone', true
  from loans join hubs using (phone_number) where borrower_id <> hub
  union all
  select distinct 'G:' || sha256(guarantor_name), 'B:' || borrower_id, 'guarantor', true
  from loans join big_backers using (guarantor_name) where borrower_id is not null)"""

_COMPONENTS = """
both_ways as (select source as a, target as b from linked union select target, source from linked),
cc(id, component) using key (id) as (
  select distinct a, a from both_ways
  union
  select w.a, min(cc.component) from cc join both_ways w on w.b = cc.id join recurring.cc as o on o.id = w.a
  where cc.component < o.component group by w.a)"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


ORACLES |= {
    "graph_nodes": _with(_LABELLED) + "select id, name, type, risk, loan_count, amount from all_nodes",
    "graph_edges": _with(_LABELLED) + "select * from all_edges",
    "phone_pairs": _with("""
firsts as (
  select phone_number, borrower_id, row_number() over (partition by phone_number order by borrower_id) as i
  from (select distinct phone_number, borrower_id from loans where phone_number is not null and borrower_id is not null))
""") + """select distinct 'B:' || a.borrower_id as source, 'B:' || b.borrower_id as target
from firsts a join firsts b on a.phone_number = b.phone_number and a.i < b.i and b.i <= 5""",
    "components": _recursive(
        _with(_LABELLED, "linked as (select * from all_edges where type = 'shared_phone')", _COMPONENTS)
    )
    + "select id, component from cc",
    "clusters": _recursive(_with(_LABELLED, "linked as (select * from all_edges where suspicious)", _COMPONENTS))
    + """select component as cluster_id, count(*) as size, count(*) filter (where risk = 'high') as high_risk_count,
  case when count(*) filter (where risk = 'high') > 2 then 'high' else 'medium' end as risk_level
from cc left join all_nodes using (id) group by component having count(*) >= 3""",
}


# --- models -----------------------------------------------------------------------------------------------------

_FACTORS = [
    ("abs(officer_volume_z) > 2", "unusual_officer_volume"),
    ("amount_vs_avg > 2", "high_loan_amount"),
    ("is_after_hours > 0", "after_hours_transaction"),
    ("shared_phone_count > 1", "shared_phone_number"),
    ("shared_guarantor_count > 2", "shared_guarantor"),
    ("officer_approval_rate > 0.9", "high_officer_approval_rate"),
    ("borrower_loan_count > 3", "multiple_loans"),
    ("geographic_density > 5", "geographic_clustering"),
]
_TIMES = """
timed as (
  select loan_id, amount, borrower_id, officer_id,
    coalesce(try_cast(split_part(approval_time, ':', 1) as int), 12) as hour,
    coalesce(try_cast(split_part(approval_time, ':', 2) as int), 0) as minute,
    isodow(loan_date) - 1 as weekday, month(loan_date) as month from loans)"""
_SCORES = """
stats as (select avg(amount) as m, stddev_pop(amount) as s from loans),
parts as (
  select loan_id, 1 / (1 + exp(-(amount - m) / s)) as f,
    case when officer_id is not null then 1 / (1 + exp(-(latitude * 40 - 1))) end as l,
    hour(created_at) / 24.0::double as t
  from loans, stats),
combined as (
  select loan_id, (coalesce(f * 0.25::double, 0) + coalesce(l * 0.1::double, 0) + coalesce(t * 0.3::double, 0))
    / (0.25::double + case when l is not null then 0.1::double else 0 end
       + case when t is not null then 0.3::double else 0 end) as score,
    1 + (l is not null)::int + (t is not null)::int as models_used
  from parts)"""
_LEVEL = "case when score >= 0.7 then 'HIGH' when score >= 0.4 then 'MEDIUM' else 'LOW' end"
_PROMPT = """'Amount: ' || cast(amount as bigint) || ' UGX | Borrower: ' || borrower_name
  || coalesce(' | Officer: ' || officer_id, '') || ' | Date: ' || loan_date || coalesce(' | Time: ' || approval_time, '')
  || ' | Branch: ' || branch_name || ' | Status: ' || status"""

ORACLES |= {
    "standard_scale": _with(*FEATURE_CTES)
    + "select loan_id, "
    + ", ".join(
        f"round(case when stddev_pop({n}) over () > 0 then ({n} - avg({n}) over ()) / stddev_pop({n}) over () else 0 end,"
        f" 4) as {n}"
        for n in _ALL_FEATURES.split()
    )
    + " from feats",
    "split_counts": _with(_LABELLED)
    + """select part, is_fraud, case part when 'train' then cast(round(n * 0.8) as bigint)
  else n - cast(round(n * 0.8) as bigint) end as loans
from (select is_fraud, count(*) as n from lab group by 1), (values ('train'), ('test')) p(part)""",
    "confusion": _with(_LABELLED)
    + """select tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) as precision,
  round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) as recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 6) as f1_score
from (
  select count(*) filter (where is_fraud and late) as tp, count(*) filter (where not is_fraud and late) as fp,
    count(*) filter (where is_fraud and not late) as fn
  from (select is_fraud, coalesce(hour(created_at), 12) < 6 or coalesce(hour(created_at), 12) >= 22 as late from lab))""",
    "roc_auc": _with(_LABELLED)
    + """select labels, sum(y) as positives, sum(1 - y) as negatives,
  round((sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::double * sum(1 - y)), 9) as roc_auc
from (
  select labels, y, rank() over w + (count(*) over (partition by labels, amount) - 1) / 2.0::double as r
  from (select 'fraud' as labels, is_fraud::int as y, amount from lab
        union all select 'late', (hour(created_at) < 6 or hour(created_at) >= 22)::int, amount from lab) x
  where amount is not null and y is not null
  window w as (partition by labels order by amount)) group by labels""",
    "minmax_risk": _with()
    + """select loan_id, round(coalesce(100 * (1 - (max(amount) over () - amount)
  / nullif(max(amount) over () - min(amount) over (), 0)), 0), 6) as anomaly_risk from loans""",
    "risk_factors": _with(*FEATURE_CTES)
    + "select loan_id, coalesce(nullif(array_to_string(fs, ','), ''), 'statistical_anomaly') as factors,"
    """ case when list_contains(fs, 'shared_phone_number') then 'ghost_loan'
    when list_contains(fs, 'geographic_clustering') or list_contains(fs, 'shared_guarantor') then 'collusion_pattern'
    when list_contains(fs, 'unusual_officer_volume') or list_contains(fs, 'high_officer_approval_rate')
      then 'officer_anomaly'
    when list_contains(fs, 'after_hours_transaction') then 'timing_anomaly'
    when list_contains(fs, 'multiple_loans') then 'loan_stacking'
    when list_contains(fs, 'high_loan_amount') then 'amount_anomaly' else 'ml_anomaly' end as alert_type
from (select loan_id, list_filter(["""
    + ", ".join(f"case when {test} then '{name}' end" for test, name in _FACTORS)
    + "], lambda x: x is not null) as fs from feats)",
    "pca_features": _with(_TIMES)
    + """select loan_id, round(amount, 6) as amount, hour::double as hour, weekday::double as weekday,
  month::double as month, (weekday >= 5)::int::double as weekend,
  round((amount - avg(amount) over ()) / (stddev_pop(amount) over () + 1e-8), 6) as amount_z from timed""",
    "ensemble_features": _with(_TIMES)
    + """select loan_id, amount, hour::double as hour, minute::double as minute,
  (hour < 8 or hour > 18)::int::double as after_hours, weekday::double as weekday, month::double as month,
  (weekday >= 5)::int::double as weekend from timed""",
    "ensemble": _with(_SCORES)
    + f"""select loan_id, round(score, 6) as ensemble_score, {_LEVEL} as risk_level, models_used,
  case when abs(score - 0.5) > 0.4 then 'Very High' when abs(score - 0.5) > 0.25 then 'High'
    when abs(score - 0.5) > 0.1 then 'Medium' else 'Low' end as confidence, score > 0.5 as is_fraud from combined""",
    "flagged_loans": _with(_SCORES)
    + f"""select loan_id, round(score, 6) as ml_score, {_LEVEL} as ml_risk,
  (select count(*) from combined) as total_loans, count(*) over () as ml_flagged from combined where score > 0.5""",
    "prompt_text": _with() + f"select loan_id, {_PROMPT} as prompt from loans",
    "batch_score": _with(f"p as (select loan_id, {_PROMPT} as prompt from loans)")
    + """select loan_id, round(score, 6) as ml_fraud_score,
  case when score > 0.7 then 'HIGH' when score > 0.4 then 'MEDIUM' else 'LOW' end as ml_risk_level
from (select loan_id, len(regexp_extract_all(prompt, '[0-9]')) / length(prompt)::double as score from p)""",
}


# --- streams and history ----------------------------------------------------------------------------------------

ORACLES |= {
    "stream_after_hours": "select event_id, user_id, ts, hour(ts) as hour from events where hour(ts) < 6 or hour(ts) >= 22",
    "stream_daily": f"""
select cast(ts as date) as day, user_id, count(*) as events, round(sum(value), 4) as total
from events group by 1, 2 having count(*) >= 2""",
    "stream_sliding": f"""
select "start", "start" + interval 30 days as "end", user_id, count(*) as events, round(avg(value), 10) as average
from (select *, unnest([date_trunc('day', ts) - to_days(cast(i as int)) for i in range(30)]) as "start" from events)
group by 1, 2, 3""",
    "stream_bursts": """
with e as (
  select user_id, ts, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as opens
  from events where event_type = 'error' window w as (partition by user_id order by ts)),
g as (select *, sum(opens) over (partition by user_id order by ts) as session from e)
select min(ts) as first_at, max(ts) as last_at, user_id, count(*) as failures
from g group by user_id, session
having count(*) >= 2""",
    "history_top": _with(
        _AMOUNT_CTE,
        _late_loans_cte("hr < 6 or hr >= 22"),
        """
found as (select branch_name, loan_date from outliers union all select branch_name, loan_date from late_loans),
sizes as (select branch_name as user_id, date_trunc('month', loan_date) as month, count(*) as n from loans group by 1, 2),
hits as (select branch_name as user_id, date_trunc('month', loan_date) as month, count(*) as a from found group by 1, 2)""",
    )
    + """select user_id, 'book-' || strftime(month, '%Y-%m') as file_name, n as loans_analyzed,
  coalesce(a, 0) as alerts_generated, cast(least(100, coalesce(a, 0) * 8) as int) as risk_score,
  cast(month as timestamp) as created_at
from sizes left join hits using (user_id, month) where user_id = 'NATION_7' order by month desc limit 10""",
}

ORACLES |= {
    "scan_csv": _with()
    + """select cast(loan_id as varchar) as loan_id, cast(borrower_id as varchar) as borrower_id, borrower_name, phone_number,
  cast(loan_date as varchar) as loan_date, guarantor_name, status from loans""",
    "scan_json": _with()
    + """select cast(loan_id as varchar) as loan_id, cast(borrower_id as varchar) as borrower_id, borrower_name,
  phone_number as phone, amount, loan_date, cast(officer_id as varchar) as officer_id, latitude from loans""",
    "result_json": _with(*ENGINE_ALERTS) + "select alert_id, alert_type, severity, amount_at_risk, loan_count from alerts",
    "report_csv": _with(*ENGINE_ALERTS)
    + """select severity, replace(alert_type, '_', ' ') as type, title, description, amount_at_risk as amount, officer_id
from alerts""",
    "scan_rejects": _with()
    + """select kind, fields, count(*) as lines from (
  select case when loan_id % 50 = 0 then 'long' when loan_id % 70 = 0 then 'short' when loan_id % 110 = 0 then 'open' end as kind,
    case when loan_id % 50 = 0 then 6 when loan_id % 70 = 0 then 2 else 4 end as fields from loans)
where kind is not null group by all
union all select 'rows', count(*) filter (where loan_id % 50 = 0 or (loan_id % 70 <> 0 and loan_id % 110 <> 0)), count(*) from loans""",
    "upload_unread": _with()
    + """select 'amount' as field, count(*) as filled, count(*) filter (where loan_id % 13 = 0) as failed from loans
union all select 'loan_date', count(case when loan_id % 17 = 0 then 'x' else loan_date::varchar end), count(*) filter (where loan_id % 17 = 0) from loans
union all select 'lines', 0, 0""",
    "preview_rows": _with() + "select loan_id, borrower_id, amount from loans order by loan_id limit 10",
    "upload_overrides": _with(*ENGINE_ALERTS)
    + "select alert_type, count(*) as alerts, round(sum(amount_at_risk), 2) as amount_at_risk from alerts group by 1",
    "phone_stars": _with("""
hubs as (
  select phone_number, min(borrower_id) as hub from loans where phone_number is not null and borrower_id is not null
  group by 1 having count(distinct borrower_id) > 1)""")
    + """select distinct 'B:' || hub as source, 'B:' || borrower_id as target
from loans join hubs using (phone_number) where borrower_id is not null and borrower_id <> hub""",
    "combined_score": _with()
    + """select loan_id, round(0.6 * (amount / max(amount) over ()) * 100 + 0.4 * day(loan_date)::double, 6) as risk_score
from loans""",
    "reconstruction_given": _with(_TIMES, """
inputs as (
  select loan_id, (weekday >= 5)::int::double as weekend, month::double as month, (weekday >= 5)::int::double as w,
    (amount - avg(amount) over ()) / (stddev_pop(amount) over () + 1e-8) as z from timed),
errors as (select loan_id, (month * month + weekend * weekend + z * z) / 6 as e from inputs)""")
    + """select loan_id, round(e, 6) as mse, round(least(e / 10.0, 1.0), 6) as anomaly_score, e > 5.0 as is_anomaly from errors""",
}

ORACLES["analysis_rule_only"] = (
    _with(*BACKEND_ALERTS)
    + "select *, total_alerts as rule_alerts, cast(0 as bigint) as ml_alerts,"
    + " (select count(*) from loans) as total_records from ("
    + _PORTFOLIO.format(points=_BACKEND_POINTS)
    + ")"
)


# --- local outlier factor ---------------------------------------------------------------------------------------

# Every row's neighbours by brute force over a band of amounts. Twenty rows stand within `r` of an amount (the twentieth
# before or behind it in order), and the other coordinates are at most 66 apart, so none nearer lies outside the band.
ORACLES["lof"] = (
    _with(
        _TIMES,
        """x as (
  select loan_id, coalesce(amount, 0)::double as a, hour::double as h, minute::double as m, (hour < 8 or hour > 18)::int::double as late,
    weekday::double as wd, month::double as mo, (weekday >= 5)::int::double as we from timed),
banded as (
  select *, least(coalesce(a - lag(a, 20) over w, 1e300), coalesce(lead(a, 20) over w - a, 1e300)) + 66 as r
  from x window w as (order by a, loan_id)),
pairs as (
  select p.loan_id as id, q.loan_id as other, sqrt((p.a - q.a) ** 2 + (p.h - q.h) ** 2 + (p.m - q.m) ** 2
    + (p.late - q.late) ** 2 + (p.wd - q.wd) ** 2 + (p.mo - q.mo) ** 2 + (p.we - q.we) ** 2) as d
  from banded p join x q on q.a between p.a - p.r and p.a + p.r and p.loan_id <> q.loan_id),
radius as (select id, list_max(min(d, 20)) as radius from pairs group by id),
near as (select id, other, d from pairs join radius using (id) where d <= radius),
density as (
  select n.id, 1 / (avg(greatest(d, radius)) + 1e-10) as density
  from near n join radius r on r.id = n.other group by n.id),
factor as (
  select n.id as loan_id, round(avg(o.density) / any_value(p.density), 6) as lof
  from near n join density o on o.id = n.other join density p on p.id = n.id group by n.id)""",
    )
    + "select loan_id, lof, lof > (select quantile_disc(lof, 0.9) from factor) as is_outlier from factor"
)


# --- meaning of headers -----------------------------------------------------------------------------------------


def _word_grams(table: str, text: str, key: str) -> str:
    return f"""(select distinct {key}, substr(' ' || w || ' ', i, 3) as g
  from (select {key}, w, unnest(range(1, length(w) + 1)) as i
        from (select {key}, unnest(string_split_regex(lower({text}), '[^a-z0-9]+')) as w from {table}) where w <> ''))"""


_MEANINGS = ", ".join(f"({i}, '{f}', '{f} {words}')" for i, (f, words) in enumerate(FIELD_MEANINGS.items()))
ORACLES["semantic_headers"] = f"""
with fields(place, field, meaning) as (values {_MEANINGS}),
headers as (select distinct header from (
  select p_name as header from part union all select p_type from part union all select n_name from nation)),
fg as {_word_grams("fields", "meaning", "place")},
hg as {_word_grams("headers", "header", "header")},
weights as (select g, ln(1 + (select count(*) from fields) / count(*)::double) ** 2 as w from fg group by g),
sizes as (select place, sqrt(sum(w)) as size from fg join weights using (g) group by place),
own as (select header, sqrt(sum(coalesce(w, ln(1 + (select count(*) from fields)::double) ** 2))) as size from hg left join weights using (g) group by header),
dots as (select header, place, sum(w) as dot from hg join fg using (g) join weights using (g) group by header, place),
scored as (
  select o.header, f.place, f.field, round(coalesce(dot, 0) / (o.size * s.size), 9) as score
  from own o cross join fields f join sizes s using (place) left join dots d on d.header = o.header and d.place = f.place)
select header, arg_max(field, (score, -place)) as field, round(max(score), 6) as score from scored group by header
union all select header, null, null from headers where header not in (select header from own)
"""

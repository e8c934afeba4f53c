"""Set operations: L3, L4."""

from __future__ import annotations

from ..registry import sql_query

_A, _B = "SELECT c_nationkey AS k FROM {customer}", "SELECT s_nationkey AS k FROM {supplier}"
for _op in ("UNION", "UNION ALL", "INTERSECT", "EXCEPT", "INTERSECT ALL", "EXCEPT ALL"):
    sql_query(f"l{4 if _op in ('INTERSECT ALL', 'EXCEPT ALL') else 3}_{_op.lower().replace(' ', '_')}", f"{_A} {_op} {_B}", tables="customer supplier")

# sides that each have rows of their own
_C, _D = "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'", "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'P'"
for _op in ("INTERSECT", "EXCEPT", "EXCEPT ALL"):
    sql_query(f"l3_orders_{_op.lower().replace(' ', '_')}", f"{_C} {_op} {_D}", tables="orders")

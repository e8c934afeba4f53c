"""Scalar functions: F1-F12."""

from __future__ import annotations

from ..registry import query, sql_query, table

sql_query("f1_strings", "SELECT c_custkey, split(c_name, '#')[0] AS head, cast(levenshtein(c_name, c_mktsegment) AS int) AS lev, regexp_replace(c_name, '[0-9]+', 'N') AS masked, cast(length(c_name) AS int) AS len, md5(c_name) AS m, sha2(c_name, 256) AS s FROM {customer}", "SELECT c_custkey, string_split(c_name, '#')[1] AS head, levenshtein(c_name, c_mktsegment)::INT AS lev, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS masked, length(c_name)::INT AS len, md5(c_name) AS m, sha256(c_name) AS s FROM customer", "customer")
sql_query("f2_strings", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, split_part(url, '/', 3) AS host, translate(url, ':/', '|_') AS t, cast(regexp_count(url, '[0-9]') AS int) AS digits FROM {pages}", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, split_part(url, '/', 3) AS host, translate(url, ':/', '|_') AS t, len(regexp_extract_all(url, '[0-9]'))::INT AS digits FROM pages", "pages")
sql_query("f3_dates", "SELECT o_orderkey, datediff(o_orderdate, DATE '1995-01-01') AS days, weekofyear(o_orderdate) AS week, cast(add_months(o_orderdate, 2) AS date) AS later, cast(date_trunc('month', o_orderdate) AS date) AS month FROM {orders}", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS days, weekofyear(o_orderdate)::INT AS week, (o_orderdate::DATE + INTERVAL 2 MONTH)::DATE AS later, date_trunc('month', o_orderdate)::DATE AS month FROM orders", "orders")
sql_query("f4_intervals", "SELECT event_id, cast(ts + make_dt_interval(1, 2, 3, 4) AS timestamp_ntz) AS later FROM {events}", "SELECT event_id, ts + INTERVAL '1 day 2 hours 3 minutes 4 seconds' AS later FROM events", "events")
sql_query("f5_math", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, l_orderkey div 7 AS d, l_orderkey % 7 AS m, round(ln(l_extendedprice), 8) AS lg, greatest(l_tax, l_discount) AS g FROM {lineitem}", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, (l_orderkey // 7)::BIGINT AS d, l_orderkey % 7 AS m, round(ln(l_extendedprice), 8) AS lg, greatest(l_tax, l_discount) AS g FROM lineitem", "lineitem")
sql_query("f6_norm", "SELECT vec_id, round(sqrt(aggregate(transform(embedding, x -> cast(x AS double) * x), cast(0 AS double), (a, x) -> a + x)), 4) AS norm FROM {embeddings}", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 4) AS norm FROM embeddings", "embeddings")
sql_query("f7_arrays", "SELECT vec_id, size(filter(embedding, x -> x > 0)) AS pos, exists(embedding, x -> x > 0.3) AS some, forall(embedding, x -> x < 1.1) AS every, round(element_at(slice(embedding, 3, 2), 1), 5) AS third, size(sequence(1, label + 1)) AS n FROM {embeddings}", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::INT AS pos, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS some, len(list_filter(embedding, lambda x: x < 1.1)) = 64 AS every, round(embedding[3], 5) AS third, (label + 1)::INT AS n FROM embeddings", "embeddings")
sql_query("f8_maps", "SELECT n_nationkey, map_filter(map('k', n_nationkey, 'r', n_regionkey), (k, v) -> v > 2)['k'] AS k, transform_values(map('r', n_regionkey), (k, v) -> v * 2)['r'] AS r FROM {nation}", "SELECT n_nationkey, CASE WHEN n_nationkey > 2 THEN n_nationkey END AS k, n_regionkey * 2 AS r FROM nation", "nation")
sql_query("f9_json", "SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k FROM {events}", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events", "events")
sql_query("f10_variant", "SELECT event_id, variant_get(parse_json(props), '$.k', 'bigint') AS k FROM {events}", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events", "events")
sql_query("f11_from_json", "SELECT event_id, from_json(props, 'k bigint').k AS k, from_csv('1,a', 'x int, y string').y AS y FROM {events}", "SELECT event_id, (props ->> '$.k')::BIGINT AS k, 'a' AS y FROM events", "events")
sql_query("f12_try", "SELECT n_nationkey, round(try_divide(100, n_regionkey), 6) AS d, try_cast(n_name AS int) AS i FROM {nation}", "SELECT n_nationkey, round(100 / nullif(n_regionkey, 0), 6) AS d, try_cast(n_name AS int) AS i FROM nation", "nation")
sql_query(
    "f2_more",
    "SELECT page_id, array_join(regexp_extract_all(url, '([a-z]+)', 1), ' ') AS words, parse_url(url, 'HOST') AS host, url_decode(url_encode(url)) AS back, url_encode(split_part(url, '?', 1)) AS coded, url COLLATE UTF8_LCASE = upper(url) AS same, left(url, 4) AS a, right(url, 3) AS z, lpad(cast(page_id AS string), 8, '0') AS padded, reverse(url) AS turned, instr(url, '/') AS slash FROM {pages}",
    "SELECT page_id, array_to_string(regexp_extract_all(url, '([a-z]+)', 1), ' ') AS words, regexp_extract(url, '://([^/?#:]*)', 1) AS host, url AS back, url_encode(split_part(url, '?', 1)) AS coded, lower(url) = lower(upper(url)) AS same, left(url, 4) AS a, right(url, 3) AS z, lpad(page_id::VARCHAR, 8, '0') AS padded, reverse(url) AS turned, instr(url, '/')::INTEGER AS slash FROM pages",
    "pages",
)
sql_query(
    "f2_sounds",
    "SELECT c_custkey, soundex(c_mktsegment) AS sound, size(sentences(c_mktsegment)) AS n, initcap(c_mktsegment) AS cap FROM {customer}",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'BUILDING' THEN 'B435' WHEN 'FURNITURE' THEN 'F653' WHEN 'HOUSEHOLD' THEN 'H243' WHEN 'MACHINERY' THEN 'M256' END AS sound, 1 AS n, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS cap FROM customer",
    "customer",
)
sql_query(
    "f4_zones",
    "SELECT event_id, convert_timezone('UTC', '+03:00', ts) AS there, ts + make_interval(0, 1, 0, 2, 3, 4, 5) AS later FROM {events}",
    "SELECT event_id, ts + INTERVAL 3 HOUR AS there, ts + INTERVAL 1 MONTH + INTERVAL 2 DAY + INTERVAL 3 HOUR + INTERVAL 4 MINUTE + INTERVAL 5 SECOND AS later FROM events",
    "events",
)
sql_query("f5_bround", "SELECT l_orderkey, l_linenumber, bround(l_quantity / 4, 1) AS even, ceil(l_tax * 100) AS up, floor(l_discount * 100) AS down, sign(l_tax - l_discount) AS s, pmod(l_linenumber - 5, 3) AS m, round(sqrt(l_quantity), 8) AS r, least(l_tax, l_discount) AS g FROM {lineitem}",
    "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS even, ceil(l_tax * 100)::BIGINT AS up, floor(l_discount * 100)::BIGINT AS down, sign(l_tax - l_discount)::DOUBLE AS s, (((l_linenumber - 5) % 3 + 3) % 3)::INTEGER AS m, round(sqrt(l_quantity), 8) AS r, least(l_tax, l_discount) AS g FROM lineitem", "lineitem")
sql_query(
    "f7_more",
    "SELECT n_nationkey, array_join(transform(arrays_zip(array(n_nationkey, 1), array(n_regionkey, 2)), z -> z['0'] * 10 + z['1']), ',') AS zipped, array_join(flatten(array(array(n_nationkey), array(n_regionkey, 7))), ',') AS flat, array_join(array_sort(array_distinct(array(n_nationkey, n_regionkey, 1))), ',') AS once, array_join(array_sort(array_union(array(n_nationkey), array(n_regionkey, 3))), ',') AS either, array_contains(array(1, 2, 3), n_regionkey) AS inside, cast(array_position(array(4, 3, 2, 1, 0), n_regionkey) AS bigint) AS at, array_max(array(n_nationkey, n_regionkey)) AS most, array_join(array_except(array(0, 1, 2, 3, 4), array(n_regionkey)), ',') AS rest, array_join(array_repeat(n_regionkey, 3), '') AS again FROM {nation}",
    "SELECT n_nationkey, (n_nationkey * 10 + n_regionkey)::VARCHAR || ',12' AS zipped, concat_ws(',', n_nationkey, n_regionkey, 7) AS flat, array_to_string(list_sort(list_distinct([n_nationkey, n_regionkey, 1])), ',') AS once, array_to_string(list_sort(list_distinct([n_nationkey, n_regionkey, 3])), ',') AS either, n_regionkey IN (1, 2, 3) AS inside, (5 - n_regionkey)::BIGINT AS at, greatest(n_nationkey, n_regionkey) AS most, array_to_string(list_filter([0, 1, 2, 3, 4], lambda x: x <> n_regionkey), ',') AS rest, repeat(n_regionkey::VARCHAR, 3) AS again FROM nation",
    "nation",
)
sql_query(
    "f8_more",
    "SELECT n_nationkey, transform_keys(map('k', n_nationkey), (k, v) -> concat(k, v))[concat('k', n_nationkey)] AS renamed, map_zip_with(map('a', n_nationkey), map('a', n_regionkey, 'b', 1), (k, x, y) -> coalesce(x, 0) + y)['a'] AS zipped, map_from_entries(array(struct('x', n_name)))['x'] AS made, array_join(array_sort(map_keys(map_concat(map('p', 1), map('q', n_regionkey)))), '') AS keys, map_from_arrays(array('u', 'v'), array(n_nationkey, n_regionkey))['v'] AS v, cast(cardinality(str_to_map('a:1,b:2')) AS int) AS n, map_contains_key(map(n_regionkey, 1), 2) AS has FROM {nation}",
    "SELECT n_nationkey, n_nationkey AS renamed, n_nationkey + n_regionkey AS zipped, n_name AS made, 'pq' AS keys, n_regionkey AS v, 2 AS n, n_regionkey = 2 AS has FROM nation",
    "nation",
)
sql_query(
    "f11_more",
    "SELECT event_id, to_json(named_struct('id', event_id, 'kind', event_type)) AS js, json_tuple(props, 'k') AS (k), schema_of_json('[\"x\"]') AS kind, from_csv(concat(event_id, ';', event_type), 'x bigint, y string', map('sep', ';')).y AS y, to_csv(struct(event_id, event_type)) AS csv, from_xml(concat('<r><v>', event_id, '</v></r>'), 'v bigint').v AS v, get(json_object_keys(props), 0) AS name FROM {events}",
    "SELECT event_id, chr(123) || '\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"' || chr(125) AS js, props ->> '$.k' AS k, 'ARRAY<STRING>' AS kind, event_type AS y, event_id || ',' || event_type AS csv, event_id AS v, 'k' AS name FROM events",
    "events",
)
sql_query(
    "f12_more",
    "SELECT n_regionkey, try_sum(n_nationkey) AS total, try_avg(n_nationkey) AS mean, max(try_to_number(concat('1', n_regionkey), '99')) AS number, max(try_to_number('x', '99')) IS NULL AS none, max(try_add(2147483647, n_regionkey)) AS added, max(try_element_at(array(1, 2), n_regionkey + 1)) AS item, max(try_to_timestamp('2020-13-01')) IS NULL AS bad FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, sum(n_nationkey)::BIGINT AS total, avg(n_nationkey) AS mean, ('1' || n_regionkey)::DECIMAL(2, 0) AS number, true AS none, CASE WHEN n_regionkey = 0 THEN 2147483647 END::INTEGER AS added, [1, 2][n_regionkey + 1] AS item, true AS bad FROM nation GROUP BY n_regionkey",
    "nation",
)


@query(
    "f4_times",
    "SELECT event_id, strftime(ts, '%H:%M:%S') AS at, strftime(date_trunc('hour', ts), '%H:%M:%S') AS whole_hour, (date_part('hour', ts) * 60 + date_part('minute', ts))::BIGINT AS minutes, ts::TIME < TIME '12:00:00' AS morning FROM events",
)
def times(spark, sf_dir):
    """The TIME type, which is off unless the session has it on: made from parts, cut to the hour, compared, and its distance from midnight."""
    name = "spark.sql.timeType.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        made = table(spark, sf_dir, "events").selectExpr("event_id", "make_time(hour(ts), minute(ts), second(ts)) AS t")
        return made.selectExpr("event_id", "cast(t AS string) AS at", "cast(time_trunc('HOUR', t) AS string) AS whole_hour", "time_diff('MINUTE', make_time(0, 0, 0), t) AS minutes", "t < make_time(12, 0, 0) AS morning")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)

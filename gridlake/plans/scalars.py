"""Scalar functions: URIs, paths, catalogue texts, times, digests, SQL built-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import text
from gridlake.plans.inputs import DATASET_FILE_SQL, ROOT, URI, dataset_file, frame, table
from gridlake.sources.files import base_name, relative_to, suffix_of


def uri_split(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.uri_dataset(url).alias("dataset"), text.uri_relative_path(url).alias("relative_path")
    )


def path_suffix(spark, sf_dir):
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", suffix_of(path).alias("suffix"), base_name(path).alias("base")
    )


def relative_path(spark, sf_dir):
    return dataset_file(spark, sf_dir).select(
        "path", relative_to(F.col("path"), ROOT).alias("relative_path"),
        F.concat(F.lit(URI.rstrip("/")), relative_to(F.col("path"), ROOT)).alias("uri"),
    )


def meta_keywords(spark, sf_dir):
    joined = F.concat_ws(";", "lang", "source", "doc_id")
    words = text.keywords(joined)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(words).cast("bigint").alias("n"), F.element_at(words, 2).alias("second")
    )


def meta_dates(spark, sf_dir):
    written = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy/MM/dd")).otherwise(
        F.date_format("ts", "yyyy-MM-dd")
    )
    return table(spark, sf_dir, "events").select("event_id", text.iso_date(written).alias("day"))


def epoch_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", text.epoch_days(F.col("ts")).alias("days"), text.epoch_micros(F.col("ts")).alias("micros")
    )


def iso_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.iso_time(F.col("ts")).alias("time"))


def blob_digest(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.digest(html).alias("md5"), text.digest(html, "sha256").alias("sha256"),
        text.base64_matches(F.base64(html.cast("binary")), text.digest(html)).alias("matches"),
    )


def decode_map(spark, sf_dir):
    raw = F.create_map(
        F.encode(F.lit("lang"), "UTF-8"), F.encode("lang", "UTF-8"),
        F.encode(F.lit("text"), "UTF-8"), F.encode("text", "UTF-8"),
    )
    decoded = text.decode_map(raw)
    return table(spark, sf_dir, "documents").select(
        "doc_id", decoded["lang"].alias("lang"), decoded["text"].alias("text")
    )


def _sql(table_name: str, query: str):
    def run(spark, sf_dir):
        return frame(spark, sf_dir, table_name).sql(query).data

    return run


STRINGS = """SELECT p_partkey, upper(p_name) AS up, substring(p_name, 2, 4) AS sub,
  regexp_replace(p_name, '[aeiou]', '*') AS masked, lpad(p_brand, 12, '.') AS padded,
  split_part(p_name, ' ', 1) AS first_word, CAST(length(trim(p_name)) AS BIGINT) AS n, replace(p_type, 'E', 'e') AS swapped,
  reverse(p_brand) AS back, concat(p_brand, '/', p_type) AS joined, CAST(position('i' IN p_name) AS BIGINT) AS at,
  p_name ILIKE '%RING%' AS is_ring, left(p_name, 3) AS l3, right(p_name, 3) AS r3, repeat('x', p_size % 4) AS rep,
  translate(p_brand, '#', '-') AS dashed, starts_with(p_name, 'red') AS is_red FROM {t}"""

DATES = """SELECT o_orderkey, {trunc} AS month, extract(year FROM o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q,
  {dow} AS dow, {diff} AS days_old, {make} AS new_year, {added} AS due, {fmt} AS text,
  {last} AS month_end FROM {t}"""

MATHS = """SELECT event_id, round(value, 1) AS r1, floor(value) AS fl, ceil(value) AS ce, abs(value - 100) AS dist,
  round(sqrt(value), 6) AS root, round(ln(value + 1), 6) AS lg, round(power(value, 2), 4) AS sq,
  round(exp(-value / 100), 8) AS decay, greatest(value, 50.0) AS hi, least(value, 50.0) AS lo,
  {div} AS whole, event_id % 7 AS rest, sign(value - 50) AS side, round(sin(value), 6) AS sine,
  round(log10(value + 1), 6) AS lg10, round(cbrt(value), 6) AS cube_root, round(degrees(value), 3) AS deg FROM {t}"""

COND = """SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band,
  coalesce(nullif(event_type, 'view'), 'seen') AS kind, {iff} AS flag, nullif(user_id, 3) AS u,
  event_type IN ('click', 'view') AS is_ui, value BETWEEN 10 AND 20 AS mid,
  event_type IS DISTINCT FROM 'click' AS not_click FROM {t}"""

ARRAYS = """SELECT vec_id, {size} AS n, {total} AS total, {positive} AS n_positive, {largest} AS largest,
  {third} AS third, {top3} AS top3, {has} AS has_half FROM {t}"""

QUERIES = {
    "uri_split": (uri_split, """SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*/[^/?#]*)', 1) AS dataset,
      '/' || regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^[^:/]+://[^/]*/[^/]*/(.*)$', 1) AS relative_path
      FROM pages"""),
    "path_suffix": (path_suffix, r"""WITH p AS (SELECT page_id,
        list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS name FROM pages)
      SELECT page_id, CASE WHEN strpos(name, '.') > 1 THEN '.' || lower(list_last(string_split(name, '.'))) ELSE '' END AS suffix,
      regexp_replace(name, '\.[^.]*$', '') AS base FROM p"""),
    "relative_path": (relative_path, f"""SELECT path, substr(path, {len(ROOT) + 1}) AS relative_path,
      '{URI.rstrip("/")}' || substr(path, {len(ROOT) + 1}) AS uri FROM {DATASET_FILE_SQL}"""),
    "meta_keywords": (meta_keywords, "SELECT doc_id, 3::BIGINT AS n, source AS second FROM documents"),
    "meta_dates": (meta_dates, """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts::DATE END AS day FROM events"""),
    "epoch_days": (epoch_days, """SELECT event_id, date_diff('day', DATE '1970-01-01', ts::DATE)::DOUBLE AS days,
      epoch_us(ts) AS micros FROM events"""),
    "iso_time": (iso_time, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS time FROM events"),
    "blob_digest": (blob_digest, "SELECT page_id, md5(html) AS md5, sha256(html) AS sha256, TRUE AS matches FROM pages"),
    "decode_map": (decode_map, "SELECT doc_id, lang, text FROM documents"),
    "sql_string_fns": (
        _sql("part", STRINGS.format(t="dataframe").replace("starts_with(", "startswith(")),
        STRINGS.format(t="part").replace("regexp_replace(p_name, '[aeiou]', '*')", "regexp_replace(p_name, '[aeiou]', '*', 'g')"),
    ),
    "sql_date_fns": (
        _sql("orders", DATES.format(
            trunc="CAST(date_trunc('MONTH', o_orderdate) AS DATE)", dow="dayofweek(o_orderdate) - 1",
            diff="datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE))", make="make_date(year(o_orderdate), 1, 1)",
            added="o_orderdate + INTERVAL '90' DAY", fmt="date_format(o_orderdate, 'yyyy/MM/dd')",
            last="last_day(CAST(o_orderdate AS DATE))", t="dataframe").replace(
            "extract(year FROM o_orderdate)", "CAST(extract(year FROM o_orderdate) AS BIGINT)").replace(
            "extract(quarter FROM o_orderdate)", "CAST(extract(quarter FROM o_orderdate) AS BIGINT)").replace(
            "dayofweek(o_orderdate) - 1", "CAST(dayofweek(o_orderdate) - 1 AS BIGINT)").replace(
            "datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE))",
            "CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)")),
        DATES.format(
            trunc="date_trunc('month', o_orderdate)::DATE", dow="dayofweek(o_orderdate)",
            diff="date_diff('day', o_orderdate::DATE, DATE '2000-01-01')", make="make_date(year(o_orderdate), 1, 1)",
            added="o_orderdate + INTERVAL 90 DAY", fmt="strftime(o_orderdate, '%Y/%m/%d')",
            last="last_day(o_orderdate::DATE)", t="orders"),
    ),
    "sql_math_fns": (
        _sql("events", MATHS.format(div="event_id div 7", t="dataframe").replace(
            "floor(value)", "CAST(floor(value) AS DOUBLE)").replace("ceil(value)", "CAST(ceil(value) AS DOUBLE)").replace(
            "greatest(value, 50.0)", "greatest(value, 50.0D)").replace("least(value, 50.0)", "least(value, 50.0D)")),
        MATHS.format(div="event_id // 7", t="events").replace("50.0)", "50.0::DOUBLE)").replace(
            "sign(value - 50)", "sign(value - 50)::DOUBLE"),
    ),
    "sql_array_fns": (
        _sql("embeddings", ARRAYS.format(
            size="CAST(size(embedding) AS BIGINT)",
            total="round(aggregate(embedding, 0D, (a, x) -> a + x), 5)",
            positive="CAST(size(filter(embedding, x -> x > 0)) AS BIGINT)", largest="array_max(embedding)",
            third="element_at(embedding, 3)",
            top3="array_join(transform(slice(sort_array(embedding, false), 1, 3), x -> CAST(round(x * 1000) AS INT)), ',')",
            has="exists(embedding, x -> x > 0.25)", t="dataframe")),
        ARRAYS.format(
            size="len(embedding)", total="round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5)",
            positive="len(list_filter(embedding, lambda x: x > 0))", largest="list_max(embedding)",
            third="embedding[3]",
            top3="array_to_string(list_transform(list_reverse_sort(embedding)[1:3], lambda x: round(x::DOUBLE * 1000)::INT), ',')",
            has="len(list_filter(embedding, lambda x: x > 0.25)) > 0", t="embeddings"),
    ),
    "sql_map_fns": (
        _sql("part", """SELECT p_partkey, array_join(map_keys(m), ',') AS keys, m['size'] AS size_text,
          element_at(m, 'brand') AS brand, CAST(cardinality(m) AS BIGINT) AS n, map_contains_key(m, 'type') AS has_type FROM (
          SELECT p_partkey, map_from_arrays(array('brand', 'type', 'size'),
            array(p_brand, p_type, CAST(p_size AS STRING))) AS m FROM dataframe)"""),
        """SELECT p_partkey, array_to_string(map_keys(m), ',') AS keys, m['size'] AS size_text, m['brand'] AS brand,
          cardinality(m)::BIGINT AS n, map_contains(m, 'type') AS has_type FROM (
          SELECT p_partkey, map(['brand', 'type', 'size'], [p_brand, p_type, p_size::VARCHAR]) AS m FROM part)""",
    ),
    "sql_json_fns": (
        _sql("events", """SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k,
          from_json(props, 'k BIGINT').k + 1 AS k1, to_json(named_struct('u', user_id)) AS packed,
          CAST(json_array_length('[1,2,3]') AS BIGINT) AS n FROM dataframe"""),
        """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, (props->>'k')::BIGINT + 1 AS k1,
          to_json({'u': user_id})::VARCHAR AS packed, json_array_length('[1,2,3]')::BIGINT AS n FROM events""",
    ),
    "sql_cond_fns": (
        _sql("events", COND.format(iff="if(value > 50, 1, 0)", t="dataframe")),
        COND.format(iff="if(value > 50, 1, 0)", t="events"),
    ),
}

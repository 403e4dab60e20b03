"""T01 to T37 and P12: scalar functions, on columns of the test tables made to look like their inputs."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidewell.functions import amounts, classes, dates, identity, records, strings
from tidewell.plans.registry import Binding, Registry, case

q = Registry()
QUERIES, SQL = q.queries, q.sql

AS_OF = datetime.date(2001, 8, 2)

_labels = Binding("part", "p_partkey", "concat('  ', p_type, '  ', p_brand, ' ') AS label")


@q(f"SELECT p_partkey, upper(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS collapsed FROM ({_labels.sql})")
def t01_collapsed(spark, sf_dir):
    return _labels.frame(spark, sf_dir).select("p_partkey", strings.collapsed(F.col("label")).alias("collapsed"))


_phones = Binding("customer", "c_custkey", case("c_custkey % 3", ["'(71)'", "''"], "'0 75'") + " AS area", case("c_custkey % 5", ["''"], "concat('9', c_name, '-', c_custkey)") + " AS number")


@q(f"""SELECT c_custkey, CASE WHEN regexp_replace(number, '[^0-9]', '', 'g') = '' THEN ''
ELSE regexp_replace(concat(area, number), '[^0-9]', '', 'g') END AS phone FROM ({_phones.sql})""")
def t02_phone(spark, sf_dir):
    return _phones.frame(spark, sf_dir).select("c_custkey", strings.phone(F.col("area"), F.col("number")).alias("phone"))


_records = Binding("customer", "c_custkey", case("c_custkey % 4", ["concat(c_custkey, '.0')", "concat(' ', c_custkey, '/7 ')", "concat('1.', c_custkey)"], "''") + " AS raw")


@q(f"""SELECT c_custkey, trim(regexp_replace(regexp_replace(trim(raw), '\\.0$', ''), '[./]', '', 'g')) AS record,
raw LIKE '%.0' OR regexp_matches(raw, '/[0-9]+$') OR regexp_matches(raw, '\\.[0-9]') AS damaged FROM ({_records.sql})""")
def t03_record_number(spark, sf_dir):
    raw = F.col("raw")
    return _records.frame(spark, sf_dir).select("c_custkey", strings.record_number(raw).alias("record"), strings.is_damaged_record_number(raw).alias("damaged"))


_short_dates = Binding(
    "orders", "o_orderkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN 'x' WHEN o_orderkey % 11 = 0 THEN '29/02' WHEN o_orderkey % 5 = 0"
    " THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING))"
    " ELSE concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) END AS raw",
)


@q(f"""WITH i AS ({_short_dates.sql}), s AS (SELECT *, CASE WHEN length(raw) = 5 THEN raw END AS short FROM i)
SELECT o_orderkey, coalesce(CAST(CASE WHEN short[4:5] || short[1:2] > '0802' THEN try_strptime(short || '/2000', '%d/%m/%Y')
ELSE try_strptime(short || '/2001', '%d/%m/%Y') END AS DATE), CAST(try_strptime(CASE WHEN length(raw) = 10 THEN raw END, '%d/%m/%Y') AS DATE)) AS inferred FROM s""")
def t04_inferred_date(spark, sf_dir):
    return _short_dates.frame(spark, sf_dir).select("o_orderkey", dates.inferred_date(F.col("raw"), AS_OF).alias("inferred"))


_dates = Binding(
    "orders", "o_orderkey",
    "CASE WHEN o_orderkey % 4 = 0 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING))"
    " WHEN o_orderkey % 4 = 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN o_orderkey % 4 = 2 THEN '31/02/2001' ELSE '' END AS raw",
)


@q(f"""SELECT o_orderkey, CAST(coalesce(CASE WHEN raw LIKE '__/__/____' THEN try_strptime(raw, '%d/%m/%Y') END,
CASE WHEN raw LIKE '____-__-__' THEN try_strptime(raw, '%Y-%m-%d') END) AS DATE) AS parsed FROM ({_dates.sql})""")
def t05_brazilian_date(spark, sf_dir):
    return _dates.frame(spark, sf_dir).select("o_orderkey", dates.brazilian_date(F.col("raw")).alias("parsed"))


_two_digits = Binding("orders", "o_orderkey", "concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/05/', CASE WHEN o_orderkey % 2 = 0 THEN '19' ELSE '2019' END) AS raw")


@q(f"SELECT o_orderkey, CASE WHEN length(raw) = 8 THEN raw[1:6] || '20' || raw[7:8] ELSE raw END AS full_year FROM ({_two_digits.sql})")
def t06_four_digit_year(spark, sf_dir):
    return _two_digits.frame(spark, sf_dir).select("o_orderkey", dates.four_digit_year(F.col("raw")).alias("full_year"))


@q("""SELECT o_orderkey, (2001 - year(o_orderdate) - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) <= 802 THEN 0 ELSE 1 END)::INTEGER AS age FROM orders""")
def t07_age(spark, sf_dir):
    return Binding("orders", "o_orderkey", "o_orderdate").frame(spark, sf_dir).select("o_orderkey", dates.age_in_years(F.col("o_orderdate"), AS_OF).alias("age"))


@q("SELECT o_orderkey, CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS day FROM orders")
def t08_date_range(spark, sf_dir):
    rows = Binding("orders", "o_orderkey", "CAST(o_orderdate AS DATE) AS first", "CAST(o_orderkey % 4 AS INT) AS n").frame(spark, sf_dir)
    return rows.select("o_orderkey", F.explode(F.sequence("first", F.date_add("first", F.col("n")))).alias("day"))


@q("""SELECT event_id, CAST(ts AS DATE) AS day, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS weekday, isodow(ts) >= 6 AS weekend, ts + INTERVAL 3 HOUR AS utc FROM events""")
def t09_t10_t11_time_parts(spark, sf_dir):
    ts = F.col("ts")
    return Binding("events", "event_id", "ts").frame(spark, sf_dir).select(
        "event_id", F.to_date(ts).alias("day"), F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday"), dates.is_weekend(ts).alias("weekend"),
        dates.in_zone_as_utc(ts).cast("timestamp_ntz").alias("utc"),
    )


@q("""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + to_seconds(event_id % 400) END AS finished FROM events)
SELECT event_id, epoch_us(finished) / 1e6 - epoch_us(ts) / 1e6 AS seconds, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9)::BIGINT AS hours,
CASE WHEN finished IS NULL THEN '' WHEN event_id % 400 < 60 THEN (event_id % 400) || 's' WHEN event_id % 400 % 60 = 0 THEN (event_id % 400 // 60) || 'm'
ELSE (event_id % 400 // 60) || 'm ' || (event_id % 400 % 60) || 's' END AS shown,
CASE WHEN event_id % 3 = 1 THEN '1 dia' ELSE (event_id % 3) || ' dias' END AS stay FROM e""")
def t12_t13_t33_t35_durations(spark, sf_dir):
    rows = Binding("events", "event_id", "ts", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + make_dt_interval(0, 0, 0, event_id % 400) END AS finished").frame(spark, sf_dir)
    seconds = dates.seconds_between(F.col("ts"), F.col("finished"))
    hours = dates.hours_since(F.col("ts"), F.lit("2024-02-01").cast("timestamp_ntz"))
    return rows.select("event_id", seconds.alias("seconds"), hours.alias("hours"), dates.duration_text(seconds).alias("shown"), dates.days_text(F.col("event_id") % 3).alias("stay"))


@q("""SELECT o_orderkey, round((o_orderkey % 37)::DECIMAL(20,0) * 100 / nullif(o_orderkey % 41, 0)::DECIMAL(20,0), 2)::DECIMAL(12,2) AS pct,
((o_orderkey % 5000) * 0.005 / 1000 + (o_orderkey % 700) * 0.015 / 1000)::DECIMAL(18,6) AS cost FROM orders""")
def t14_t15_amounts(spark, sf_dir):
    k = F.col("o_orderkey")
    return Binding("orders", "o_orderkey").frame(spark, sf_dir).select("o_orderkey", amounts.percentage(k % 37, k % 41).alias("pct"), amounts.token_cost(k % 5000, k % 700).alias("cost"))


@q("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '---' ELSE 'R$ ' || translate(format('{:,.2f}', (o_orderkey * 7 % 3000000)::DECIMAL(18,2)), ',.', '.,') END AS price FROM orders""")
def t16_brl(spark, sf_dir):
    k = F.col("o_orderkey")
    return Binding("orders", "o_orderkey").frame(spark, sf_dir).select("o_orderkey", amounts.brl(F.when(k % 9 != 0, k * 7 % 3000000)).alias("price"))


@q("""SELECT event_id, sha256('tasy|' || user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || event_type) AS identity, sha256(props) AS content,
sha1(props)[1:12] AS recovery, 'UNMAPPED-CODE-' || sha256('code' || chr(0) || event_type)[1:20] AS synthetic FROM events""")
def t17_t18_digests(spark, sf_dir):
    rows = Binding("events", "event_id", "user_id", "CAST(CAST(ts AS DATE) AS STRING) AS day", "event_type", "props").frame(spark, sf_dir)
    key = identity.event_identity(F.lit("tasy"), F.col("user_id"), F.col("day"), F.col("event_type"))
    return rows.select("event_id", key.alias("identity"), identity.content_hash(F.col("props")).alias("content"), identity.recovery_key(F.col("props")).alias("recovery"), identity.synthetic_key(F.lit("code"), F.col("event_type")).alias("synthetic"))


_beds = Binding(
    "events", "event_id",
    "CASE WHEN event_id % 3 = 0 THEN concat(' ', user_id) ELSE ' ' END AS record",
    case("event_id % 8", ["' desocupado'", "'VAZIO'", "'em limpeza'", "'Reserva interna'", "'isolamento '", "'LIMPEZA RESERVA'", "''"], "'outro'") + " AS name",
    case("event_id % 10", ["'11'", "'12'", "' 3m2d '", "'144m'", "'143M 30 D'", "'143m31d'", "'-1'", "'2.5'", "''"], "NULL") + " AS age",
)


@q(f"""WITH s AS (SELECT *, CASE WHEN trim(record) <> '' THEN 'occupied' WHEN upper(name) LIKE '%DESOCUPADO%' OR upper(name) LIKE '%VAZIO%' THEN 'empty'
WHEN upper(name) LIKE '%LIMPEZA%' THEN 'maintenance' WHEN upper(name) LIKE '%RESERVA%' THEN 'reserved' WHEN upper(name) LIKE '%ISOLAMENTO%' THEN 'isolation' ELSE 'empty' END AS status,
trim(coalesce(age, '')) AS a FROM ({_beds.sql})),
m AS (SELECT *, regexp_extract(a, '(?i)^([0-9]+)\\s*m\\s*(([0-9]+)\\s*d)?$', ['m', 'x', 'd']) AS g FROM s)
SELECT event_id, status, CASE WHEN status <> 'occupied' THEN 'not_applicable'
WHEN regexp_matches(a, '^[0-9]+$') THEN CASE WHEN try_cast(a AS INT) >= 12 THEN 'age_12_or_over' ELSE 'under_12' END
WHEN g.m <> '' THEN CASE WHEN try_cast(g.m AS INT) * 365 + coalesce(try_cast(g.d AS INT), 0) * 12 >= 52560 THEN 'age_12_or_over' ELSE 'under_12' END ELSE 'unknown' END AS band FROM m""")
def t19_t20_bed_status_and_age_band(spark, sf_dir):
    rows = _beds.frame(spark, sf_dir).withColumn("status", classes.bed_status(F.col("record"), F.col("name")))
    return rows.select("event_id", "status", classes.age_band(F.col("age"), F.col("status")).alias("band"))


_signatures = Binding(
    "events", "event_id",
    case("event_id % 9", ["'Dr CRM 1'", "'COREN-BA 2'", "'crefito 3'", "'CRN 4'", "'CREFONO 5'", "'CRO 6'", "NULL"], "'x'") + " AS signature",
    "CASE WHEN event_id % 2 = 0 THEN 'Avaliação de Odontologia' ELSE event_type END AS content",
    case("event_id % 4", ["' Physiotherapy'", "'phisiotherapy'", "NULL"], "'Medica '") + " AS job",
    case("event_id % 6", ["'NavigationTimeoutError'", "'InvalidJsonError'", "'ValidationError'", "'ExtractionError'", "'EvolutionPdfError'"], "'TimeoutError'") + " AS error",
    case("event_id % 5", ["'Sala 1'", "'Apsida'", "'Pronto Atendimento'", "NULL"], "'UTI'") + " AS sector",
)


@q(f"""SELECT event_id, CASE WHEN signature ILIKE '%crm%' THEN 'medical' WHEN signature ILIKE '%coren%' THEN 'nursing' WHEN signature ILIKE '%crefito%' THEN 'phisiotherapy'
WHEN signature ILIKE '%crn%' THEN 'nutrition' WHEN signature ILIKE '%crefono%' THEN 'speech_therapy' WHEN signature ILIKE '%cro%' THEN 'dentistry'
WHEN content ILIKE '%odontolog%' THEN 'dentistry' ELSE 'other' END AS author, CASE lower(trim(coalesce(job, ''))) WHEN 'phisiotherapy' THEN 'fisioterapia'
WHEN 'physiotherapy' THEN 'fisioterapia' ELSE lower(trim(coalesce(job, ''))) END AS profession,
CASE error WHEN 'NavigationTimeoutError' THEN 'timeout' WHEN 'InvalidJsonError' THEN 'invalid_payload' WHEN 'EvolutionPdfError' THEN 'invalid_payload'
WHEN 'ValidationError' THEN 'validation_error' WHEN 'ExtractionError' THEN 'source_unavailable' ELSE 'unexpected_exception' END AS reason,
coalesce(upper(sector) LIKE '%SALA%' OR upper(sector) LIKE '%PS%' OR upper(sector) LIKE '%PRONTO%', false) AS high_turnover FROM ({_signatures.sql})""")
def t21_t22_t24_p12_classes(spark, sf_dir):
    c = F.col
    return _signatures.frame(spark, sf_dir).select(
        "event_id", classes.author_category(c("signature"), c("content")).alias("author"), classes.profession(c("job")).alias("profession"),
        classes.failure_reason(c("error")).alias("reason"), classes.is_high_turnover(c("sector")).alias("high_turnover"),
    )


_reports = Binding("documents", "doc_id", "replace(text, '|', ' ') AS text")


@q(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM ({_reports.sql})),
t AS (SELECT doc_id, position, trim(regexp_replace(line, '[\\f\\r]', '', 'g'), ' ') AS line FROM l),
k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY position) AS before FROM t WHERE NOT regexp_matches(line, '^(The|Les) ')),
b AS (SELECT * FROM k WHERE NOT (line = '' AND coalesce(before, '') = '')),
e AS (SELECT *, sum(regexp_matches(line, '^[A-E]')::INT) OVER (PARTITION BY doc_id ORDER BY position) AS event FROM b),
c AS (SELECT *, coalesce(sum(regexp_matches(line, '[aeo][.]$')::INT) OVER (PARTITION BY doc_id, event ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e WHERE event > 0)
SELECT doc_id, event::BIGINT AS event, min(position)::INTEGER AS first, max(position)::INTEGER AS last, sha256(string_agg(line, chr(10) ORDER BY position)) AS content_sha256,
bool_or(regexp_matches(line, '[aeo][.]$')) AS closed FROM c WHERE ended = 0 GROUP BY 1, 2""")
def t25_t26_s23_report_events(spark, sf_dir):
    lines = records.without_artifacts(records.report_lines(_reports.frame(spark, sf_dir), "doc_id", "text"), "doc_id", "^(The|Les) ")
    return records.report_events(lines, "doc_id", "^[A-E]", "[aeo][.]$").withColumn("content_sha256", F.sha2("content", 256)).drop("content")


_closing = Binding(
    "orders", "o_orderkey",
    "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'Elaborado por: ' ELSE 'Assinado por ' END, o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN ' sem data' ELSE ' em: 0' END,"
    " CAST(o_orderkey % 9 + 1 AS STRING), '/03/2024', CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN ' 09:30' ELSE ' 21:05:07' END) AS line",
)


@q(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE regexp_extract(line, 'por[: ]+(.+) em:', 1) END AS author,
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE make_timestamp(2024, 3, o_orderkey % 9 + 1, CASE WHEN o_orderkey % 4 = 0 THEN 12 WHEN o_orderkey % 4 = 1 THEN 9 ELSE 21 END,
CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN 30 ELSE 5 END, CASE WHEN o_orderkey % 4 > 1 THEN 7 ELSE 0 END) END AS signed_at FROM ({_closing.sql})""")
def t27_signatures(spark, sf_dir):
    return _closing.frame(spark, sf_dir).select("o_orderkey", records.signature_author(F.col("line")).alias("author"), records.signature_time(F.col("line")).cast("timestamp_ntz").alias("signed_at"))


_objects = Binding(
    "events", "event_id", "props",
    "CASE WHEN event_id % 3 = 0 THEN '{\"k\": \"9\", \"Data Alta\": \"2024\", \"blank\": \"\"}' WHEN event_id % 3 = 1 THEN '{\"data_alta\": \"\", \"DATA ALTA\": \"x\"}' ELSE NULL END AS extra",
)


@q(f"""WITH e AS (SELECT event_id, event_id % 3 AS m, CASE WHEN event_id % 3 = 0 THEN '9' ELSE json_extract_string(props, '$.k') END AS k FROM ({_objects.sql}))
SELECT event_id, k AS merged_k, CASE m WHEN 0 THEN '2024' WHEN 1 THEN 'x' END AS alta, CASE m WHEN 0 THEN 'Data Alta' WHEN 1 THEN 'DATA ALTA' ELSE '' END AS extra_keys,
CASE m WHEN 0 THEN 'Data Alta,blank' WHEN 1 THEN 'DATA ALTA,data_alta' ELSE '' END AS other_keys,
CASE WHEN length(k) = 1 THEN 'missing:blank' ELSE 'pattern:k,missing:blank' END AS errors FROM e""")
def t28_t29_t30_t31_t36_records(spark, sf_dir):
    record = records.merged_fields(F.col("props"), F.col("extra"))
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return _objects.frame(spark, sf_dir).select(
        "event_id", record["k"].alias("merged_k"), records.by_alias(record, "dataAlta", "data_alta").alias("alta"), names(records.extra_fields(record, "k")).alias("extra_keys"),
        names(records.without_key(record, "k")).alias("other_keys"), F.array_join(records.contract_errors(record, {"k": "^[0-9]$", "blank": "."}), ",").alias("errors"),
    )


@q("""SELECT o_custkey, array_to_string(list_distinct_ordered, ',') AS labels FROM (SELECT o_custkey, list(p ORDER BY first) AS list_distinct_ordered FROM
(SELECT o_custkey, trim(o_orderpriority) AS p, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1)""")
def t32_ordered_labels(spark, sf_dir):
    rows = Binding("orders", "o_custkey", "o_orderkey", "o_orderpriority").frame(spark, sf_dir)
    labels = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return rows.groupBy("o_custkey").agg(F.array_join(records.ordered_labels(labels), ",").alias("labels"))


@q("SELECT doc_id, substr(text, 1, 300) AS short FROM documents")
def t34_cut(spark, sf_dir):
    return Binding("documents", "doc_id", "text").frame(spark, sf_dir).select("doc_id", strings.cut(F.col("text"), 300).alias("short"))


@q("SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS plain_sha256 FROM pages")
def t37_without_tags(spark, sf_dir):
    return Binding("pages", "page_id", "html").frame(spark, sf_dir).select("page_id", F.sha2(strings.without_tags(F.col("html")), 256).alias("plain_sha256"))

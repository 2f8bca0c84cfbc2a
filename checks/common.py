from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# DuckDB form of netshield.sources.testdata.
LOGS = """
timed AS (
  SELECT *, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 7200 AS us FROM events
),
logs AS (
  SELECT event_id AS seq,
    CASE WHEN user_id % 10 IN (0, 5) THEN '100.100.100.100'
         WHEN user_id % 10 = 1 THEN '31.13.64.' || (user_id % 250)
         WHEN user_id % 10 = 2 THEN '1.117.3.' || (user_id % 250)
         WHEN user_id % 10 = 3 THEN '2.56.150.9'
         WHEN user_id % 10 = 4 THEN '2607:6bc0:0:1::5'
         WHEN user_id % 10 = 6 THEN '10.1.2.' || (user_id % 250)
         ELSE '203.0.113.' || (user_id % 20) END AS ip,
    make_timestamp(us) AS ts, us, us // 60000000 AS minute,
    'd' || (user_id % 3) || '.example.com' AS domain,
    CASE WHEN event_type IN ('view', 'click') THEN 'GET' WHEN event_type = 'error' THEN 'HEAD'
         ELSE 'POST' END
      || ' ' || CASE WHEN event_id % 13 = 0 THEN '/a/app.js' ELSE '/p/' || (event_id % 17) END
      || ' ' || CASE WHEN user_id % 3 = 0 THEN 'HTTP/2.0' ELSE 'HTTP/1.1' END AS request,
    event_id % 800 + 200 AS request_length,
    CAST(CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 404
              WHEN event_type = 'error' THEN 500
              WHEN event_id % 7 = 0 THEN 301 ELSE 200 END AS INTEGER) AS status,
    CAST(round(value * 100) AS BIGINT) AS bytes_sent,
    value / 1000 AS request_time,
    'agent/' || (user_id % 7) AS user_agent
  FROM timed
)
"""


def with_logs(body: str) -> str:
    """Prefix a query (which may start with further CTEs) with the access-log CTEs."""
    return f"WITH {LOGS}{body}"


def ntz(name: str) -> Column:
    """Timestamp without zone, the type DuckDB returns."""
    return F.col(name).cast("timestamp_ntz").alias(name)


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def plain_types(df: DataFrame) -> DataFrame:
    """Every timestamp column as timestamp_ntz."""
    return df.select(*[ntz(f.name) if f.dataType.typeName() == "timestamp" else f.name
                       for f in df.schema.fields])


def over_logs(spark, text: str, logs: DataFrame) -> DataFrame:
    """Run SQL text over the access log named ``{logs}``; other braces are literal."""
    escaped = text.replace("{", "{{").replace("}", "}}").replace("{{logs}}", "{logs}")
    return spark.sql(escaped, logs=logs)

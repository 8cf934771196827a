"""AIS-shaped messages computed from the ``events`` table.

The text is plain SQL that Spark and DuckDB read alike, so the same view feeds
the queries and their checks. Every fiftieth event appears twice on purpose:
these are the duplicates that deduplication has to find. Every sixth one is moved to
the next month, so that jobs and sources have two months to keep apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MESSAGES_SQL = """
with e as (select * from {events} union all
           select * from {events} where event_id % 50 = 0)
select
 366000000 + user_id as MMSI,
 replace(replace(substring(cast(ts as varchar(64)),1,19),' ','T'), '2024-01-',
   case when event_id % 6 = 0 and substring(cast(ts as varchar(64)),9,2) <= '28'
        then '2024-02-' else '2024-01-' end) as BaseDateTime,
 case when event_id % 97 = 0 then cast(91 as double)
      else cast(event_id*7919 % 2600 as double)/100 + 24 end as LAT,
 cast(event_id*104729 % 6000 as double)/100 - 125
      + case when event_id % 89 = 0 then 360 else 0 end as LON,
 value/4 as SOG,
 cast(event_id*37 % 7200 as double)/10 as COG,
 case when event_id % 10 = 0 then cast(511 as double)
      else cast(event_id*53 % 3600 as double)/10 end as Heading,
 concat(' mv-', event_type, '  ', cast(user_id as varchar(20)), ' ') as VesselName,
 case when user_id % 5 = 0 then 'IMO0000000' when user_id % 7 = 0 then ''
      else concat(' IMO', cast(9000000 + user_id as varchar(20))) end as IMO,
 concat(' w', cast(user_id as varchar(20)), '-x') as CallSign,
 case when user_id % 50 = 0 then 'abc'
      else cast((user_id % 12) * 9 as varchar(20)) end as VesselType,
 case when event_id % 101 = 0 then null
      when event_id % 103 = 0 then concat(cast((event_id*13) % 18 as varchar(20)), '.0')
      when event_id % 107 = 0 then concat(' ', cast((event_id*13) % 18 as varchar(20)), ' ')
      when event_id % 109 = 0 then concat(cast((event_id*13) % 18 as varchar(20)), '.7')
      else cast((event_id*13) % 18 as varchar(20)) end as Status,
 cast((user_id*31) % 500 as double) as Length,
 cast((user_id*31) % 500 as double)/6 + (user_id % 4) as Width,
 case when user_id % 37 = 5 then cast(22 as double) when user_id % 41 = 3 then cast(30 as double)
      else cast(user_id % 6 as double) + 1 end + cast(event_id % 10 as double)/10 as Draft,
 cast((user_id*3) % 100 as varchar(20)) as Cargo,
 case when user_id % 3 = 0 then ' b ' else 'A' end as TransceiverClass
from e
"""


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages over ``<sf_dir>/events.parquet``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(MESSAGES_SQL, events=events)

"""Inputs of the queries, derived from the plain tables.

Each is one statement of a dialect that Spark and DuckDB read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

METRICAL_TEXT = r"""
with k as (
  select o_orderkey as rec_id, o_orderkey % 4 as kind, cast(floor(o_orderkey / 4) as bigint) % 5 as dstyle,
         o_custkey as c, o_orderkey % 3 as noise,
         cast(year(o_orderdate) - 120 as string) as y, month(o_orderdate) as m, day(o_orderdate) as d
  from orders),
n as (
  select *,
   split_part('Иван|Иоанн|Пётр|Петр|Александр|Николай|Василий|Федор|Яков|Онуфрий','|', cast(c % 10 as int) + 1) as male,
   split_part('Анна|Мария|Екатерина|Ольга|Настасья|Татьяна|Фёкла','|', cast(c % 7 as int) + 1) as female,
   split_part('Иванов|Петров|Сидоров|Федоров|Смирнов|Волков|Белозёров|Попов|Козлов|Зайцев|Лаптев','|', cast(cast(floor(c / 10) as bigint) % 11 as int) + 1) as sur,
   case dstyle
     when 0 then cast(d as string) || ' ' || split_part('января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря','|', cast(m as int)) || ' ' || y || ' года'
     when 1 then cast(d as string) || ' ' || split_part('генваря|февраля|марта|апреля|маiя|июня|июля|августа|сентября|октября|ноября|декабря','|', cast(m as int)) || ' ' || y
     when 2 then cast(d as string) || '.' || split_part('I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII','|', cast(m as int)) || '.' || y
     when 3 then cast(d as string) || '/' || cast(m as string) || '/' || y
     else y || '-' || lpad(cast(m as string),2,'0') || '-' || lpad(cast(d as string),2,'0') end as dt
  from k)
select rec_id, kind,
  case kind
   when 0 then dt || case when noise = 1 then ' р. ' else ' родился ' end || male || case when noise = 2 then 'ъ' else '' end || ', отец ' || male || ' ' || sur || ', мать ' || female || '  ' || sur || 'а .'
   when 1 then dt || case when noise = 1 then ' умерла ' else ' умер ' end || male || ' ' || sur || ', ' || cast(20 + c % 60 as string) || ' лет, погр' || case when noise = 2 then 'е' else 'ё' end || 'бён'
   when 2 then dt || ' вен-' || chr(10) || 'чался жених ' || male || ' ' || sur || '; невеста ' || female || ' ' || sur
   else 'Рязанская губ. ' || dt || ' свящ. ' || male || ' ' || sur end as raw_text
from n
"""

#: Rows and columns of pages, from line items.
ROWS = """
select l_orderkey as page_id, cast(l_linenumber - 1 as int) as ord, cast(200 * l_linenumber as int) as start_,
       cast(200 * l_linenumber + 20 + max(l_partkey) % 100 as int) as end_
from lineitem group by l_orderkey, l_linenumber
"""
COLUMNS = """
select l_orderkey as page_id, cast(l_linenumber - 1 as int) as ord, cast(300 * l_linenumber as int) as start_,
       cast(300 * l_linenumber + 50 + max(l_suppkey) % 200 as int) as end_
from lineitem group by l_orderkey, l_linenumber
"""

#: Elements of pages of all kinds, with pixel features.
ELEMENTS = """
select l_orderkey as page_id, l_linenumber * 100000000 + l_partkey as ord,
       split_part('table|record_block|header_row|data_row|data_cell|text_block|stamp|signature|page_number|data_cell','|', cast(l_partkey % 10 as int) + 1) as type,
       cast(l_suppkey % 37 * 40 as int) as x1, cast(l_partkey % 61 * 30 as int) as y1,
       cast(l_suppkey % 37 * 40 + l_partkey % 90 as int) as x2, cast(l_partkey % 61 * 30 + l_suppkey % 70 as int) as y2,
       l_quantity * 6.0 as mean, l_extendedprice % 500.0 as variance, l_discount * 1.5 as edges,
       cast(l_partkey % 3000 as double) as area, cast(l_suppkey % 400 + 1 as double) as perimeter
from (select l_orderkey, l_linenumber, l_partkey, max(l_suppkey) as l_suppkey, max(l_quantity) as l_quantity,
             max(l_extendedprice) as l_extendedprice, max(l_discount) as l_discount
      from lineitem group by l_orderkey, l_linenumber, l_partkey) t
"""

#: How busy each minute of the day is, per kind of event.
PROFILE = """
select event_type as page_id, cast(hour(ts) * 60 + minute(ts) as int) as i, cast(count(*) as double) as n
from events group by event_type, hour(ts) * 60 + minute(ts)
"""

#: Answers of three engines for the regions of pages.
OCR = """
select cast(floor(doc_id / 5) as bigint) as page_id, cast(doc_id % 5 as int) as position,
       case when doc_id % 5 = 0 then coalesce(text, '') else '' end as t1,
       case when doc_id % 3 = 0 then '' else coalesce(text, '') end as t2,
       cast(doc_id % 10 as double) / 10.0 as c2,
       case when doc_id % 7 = 0 then '' when doc_id % 4 = 1 then coalesce(text, '') || ' и прочее' else coalesce(text, '') end as t3
from documents
"""

UPLOADS = """
select 'page' || cast(doc_id as string) || split_part('.jpg|.JPEG|.png|.tiff||.pdf','|', cast(doc_id % 6 as int) + 1) as name,
       case when doc_id % 11 = 0 then null else n_chars * 20000 end as size
from documents
"""

RESULTS = """
select substring(md5(cast(o_orderkey as string)), 1, 8) as request_id, 'f' || cast(o_orderkey as string) || '.jpg' as file,
       case o_orderkey % 4 when 0 then 'birth' when 1 then 'death' when 2 then 'marriage' else null end as record_type,
       case when o_orderkey % 5 = 0 then null else o_orderkey % 2 = 0 end as needs_review,
       case when o_orderkey % 9 = 0 then null else o_totalprice end as time
from orders
"""

#: People of many surnames with parents and children.
KIN = """
select o_orderkey as rec_id, cast(o_orderkey % 3 as int) as role_no,
       case o_orderkey % 3 when 0 then 'child_name' when 1 then 'father_name' else 'mother_name' end as role,
       'Имя' || cast(o_orderkey % 50 as string) || ' С' || cast(o_custkey as string) as name, 'С' || cast(o_custkey as string) as surname,
       o_orderkey as record_hash
from orders
"""

#: Pairs of dates, written ages and reference dates.
AGES = """
select o_orderkey as rec_id,
       case when o_orderkey % 17 = 0 then 'Unknown' when o_orderkey % 13 = 0 then cast(year(o_orderdate) - 180 as string)
            else cast(year(o_orderdate) - 180 as string) || '-' || lpad(cast(month(o_orderdate) as string), 2, '0') || '-' || lpad(cast(day(o_orderdate) as string), 2, '0') end as birth,
       case when o_orderkey % 7 = 0 then 'Unknown' when o_orderkey % 19 = 0 then '1878-99-99'
            else cast(year(o_orderdate) - 180 + o_custkey % 90 - 5 as string) || '-03-05' end as death,
       case when o_orderkey % 2 = 0 then '1900-01-31' else null end as reference,
       case when o_orderkey % 6 = 0 then null else cast(o_custkey % 90 - o_orderkey % 4 as int) end as written
from orders
"""

FEASTS = """
select o_orderkey as rec_id,
       split_part('Пасха|Рождество Христово|в день Покров|Троица|около|примерно|Рождество Богородицы|Вознесение|Илин день|12 марта|Никола вешний|Введение','|', cast(o_orderkey % 12 as int) + 1)
         || case when o_orderkey % 5 = 0 then '' else ' ' || cast(year(o_orderdate) - 120 as string) end as txt,
       case when o_custkey % 3 = 0 then cast(year(o_orderdate) - 119 as int) else null end as given
from orders
"""

#: A picture's pixels per page.
PIXELS = """
select page_id, cast(x as int) as x, cast(y as int) as y, cast((page_id * 31 + x * 7 + y * 13) % 256 as int) as b,
       cast((page_id * 17 + x * 11 + y * 3) % 200 as int) as g, cast((page_id * 5 + x * 2 + y * 29) % 150 as int) as r
from (select p_partkey as page_id from part) p
cross join (select n_nationkey as x from nation) xs
cross join (select n_nationkey as y from nation where n_nationkey < 20) ys
"""

BATCHES = """
select o_custkey as batch_id, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as ord, o_orderkey % 7 <> 3 as ok
from orders
"""

BOXES = """
select l_orderkey as page_id, l_linenumber * 100000000 + l_partkey as ord,
       split_part('table|record_block|header_row|data_cell|data_cell|stamp','|', cast(l_partkey % 6 as int) + 1) as label,
       cast(l_suppkey % 30 * 15 as int) as x1, cast(l_partkey % 50 * 20 as int) as y1,
       cast(l_suppkey % 30 * 15 + 10 + l_partkey % 40 as int) as x2, cast(l_partkey % 50 * 20 + 40 as int) as y2
from (select l_orderkey, l_linenumber, l_partkey, max(l_suppkey) as l_suppkey from lineitem group by l_orderkey, l_linenumber, l_partkey) t
"""

ANSWERS_RAW = """
select o_orderkey as rec_id,
       case o_orderkey % 4
         when 0 then 'Вот: {"record_type": "birth", "child_name": {"value": "Иван ' || cast(o_custkey as string) || '", "confidence": 0.9}, "birth_date": {"value": "1878-03-12", "conf'
         when 1 then '{"record_type": "death", "deceased_name": {"value": "Анна"'
         when 2 then 'нет данных'
         else '{"record_type": "marriage", "groom_name": {"value" : "Пётр", "confidence": 0.4}, "bride_name": {"value": "Ольга", "confidence": 0.3}}' end as response
from orders
"""


def tables_of(sql: str) -> set[str]:
    names = "region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations"
    return set(re.findall(rf"\bfrom\s+({names})\b", sql))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture as a DataFrame; columns ``start_`` and ``end_`` lose their mark."""
    frames = {}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in tables_of(sql):
        df = table(spark, sf_dir, name)
        cores = spark.sparkContext.defaultParallelism
        # a small file is one split: regular expressions, or the pixels of all pages, would run in one task
        frames[name] = df.repartition(cores) if name in ("orders", "part") and df.rdd.getNumPartitions() < cores // 2 else df
        sql = re.sub(rf"\bfrom\s+{name}\b", f"from {{{name}}}", sql)
    out = spark.sql(sql, **frames)
    return out.withColumnsRenamed({"start_": "start", "end_": "end"})

"""Input views over the given tables, in SQL that Spark and DuckDB read alike.

{name} stands for a table. Each makes records with the spellings that the operators are for, one for each table row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators.settle import spread

_WIDE = "translate({0}, '0123456789-@.abcdefghijklmnopqrstuvwxyz', '０１２３４５６７８９－＠．ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ')"
_S = "cast({0} as string)"


def _pad(x: str, n: int) -> str:
    return f"lpad({_S.format(x)}, {n}, '0')"


_PHONE = f"concat('03', {_pad('g % 10000', 4)}, {_pad('(g * 7) % 10000', 4)})"
_HYPHEN = f"concat('03-', {_pad('g % 10000', 4)}, '-', {_pad('(g * 7) % 10000', 4)})"
_MAIL = f"concat('user', {_S.format('g')}, '@example.com')"

CONTACT = f"""
select c_custkey as row_index,
  case when c_custkey % 11 = 0 then '' when c_custkey % 17 = 0 then concat('　ｶﾞﾊﾟﾜ ', {_S.format('g')}, '  x') else concat('顧客', {_S.format('g')}) end as customer_name,
  case when c_custkey % 13 = 0 then '' else
    case c_custkey % 5 when 0 then {_HYPHEN} when 1 then {_WIDE.format(_HYPHEN)} when 2 then concat('+81 3 ', {_pad('g % 10000', 4)}, ' ', {_pad('(g * 7) % 10000', 4)})
      when 3 then concat(' ', {_PHONE}, ' ') else concat('12-', {_S.format('g')}) end end as phone,
  case when c_custkey % 7 = 0 then '' else case c_custkey % 4 when 0 then upper({_MAIL}) when 1 then {_WIDE.format(_MAIL)} when 2 then concat(' ', {_MAIL}, '　') else 'not a mail' end end as email,
  case when c_custkey % 19 = 0 then '' else case c_custkey % 4 when 0 then concat('(株)', c_mktsegment) when 1 then concat('㈱', c_mktsegment) when 2 then concat(c_mktsegment, '有限会社') else concat('株式会社　', c_mktsegment) end end as company_name,
  case c_custkey % 3 when 0 then concat(c_mktsegment, '支店') when 1 then concat(' ', c_mktsegment, '本店') else '' end as store_name,
  case when c_custkey % 5 = 0 then '' else concat(case c_custkey % 3 when 0 then '〒1234567　' when 1 then '１２３－４５６７ ' else '' end, '東京都 ', {_S.format('c_nationkey')}, '丁目', {_S.format('g % 50')}) end as address,
  case when c_custkey % 4 = 0 then 'サービス' else '' end as product,
  case when c_custkey % 6 = 0 then '2024-01-01' when c_custkey % 6 = 1 then '令和6年1月2日' else '' end as contract_date,
  case when c_custkey % 9 = 0 then {_S.format('c_custkey % 1000')} else '' end as amount,
  case when c_custkey % 10 = 0 then 'memo' else '' end as note
from (select *, cast(floor(c_custkey / 3) as bigint) as g from {{customer}}) c
"""

DATED = f"""
select o_orderkey as row_index,
  case o_orderkey % 7
    when 0 then concat({_S.format('y')}, '/', {_S.format('m')}, '/', {_S.format('d')})
    when 1 then concat({_S.format('y')}, {_pad('m', 2)}, {_pad('d', 2)})
    when 2 then concat('平成', {_S.format('y - 1988')}, '年', {_S.format('m')}, '月', {_S.format('d')}, '日')
    when 3 then concat('H', {_S.format('y - 1988')}, '.', {_S.format('m')}, '.', {_S.format('d')})
    when 4 then concat('　', {_WIDE.format(f"concat({_S.format('y')}, '-', {_S.format('m')}, '-', {_S.format('d')})")}, ' ')
    when 5 then concat({_S.format('y')}, '年ごろ')
    else concat({_S.format('y')}, '-', {_S.format('m + 6')}, '-', {_S.format('d + 9')}) end as contract_date,
  o_totalprice as price, o_custkey as customer
from (select *, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(day(o_orderdate) as int) as d from {{orders}}) o
"""

MIXED = f"""
select o_orderkey as row_index,
  case when o_orderkey % 4 = 0 then concat('C', {_S.format('o_custkey')}) else '' end as customer_id,
  case when o_orderkey % 4 in (0, 1) then concat('顧客', {_S.format('o_custkey')}) else '' end as customer_name,
  case when o_orderkey % 8 in (0, 1) then concat('03', {_pad('o_custkey', 8)}) else '' end as phone,
  case when o_orderkey % 16 = 2 then '東京都' else '' end as address,
  case when o_orderkey % 5 = 0 then '' else o_orderpriority end as history
from {{orders}}
"""

FLOW = f"""
select o_orderkey as row_index,
  case when o_orderkey % 4 = 0 then concat('C', {_S.format('o_custkey')}) else '' end as customer_id,
  case when o_orderkey % 4 in (0, 1) then concat('顧客', {_S.format('o_custkey')}) else '' end as customer_name,
  case when o_orderkey % 8 in (0, 1) then concat('03', {_pad('o_custkey', 8)}) else '' end as phone,
  case when o_orderkey % 16 = 2 or o_orderkey % 24 = 0 then '東京都' else '' end as address,
  case when o_orderkey % 5 = 0 then '' else o_orderpriority end as history,
  case when o_orderkey % 3 = 0 then 'memo' else '' end as note
from {{orders}}
"""

_NAMES = ["電話番号", "TEL番号", "メール", "会社名", "氏名", "お名前", "住所", "契約日", "対応日", "対応種別", "リスト名", "商材", "訪問予定", "状況", "進捗状況", "金額", "見積番号", "書類", "原価", "備考", "ID", "作成日", "更新日", "項目1", "項目2", "ｺｰﾙ履歴::日付", "<テーブルが見つかりません>", "メーカー", "営業担当", "結果"]
HEADERS = f"""
select c_custkey as column_id,
  concat('file', {_S.format('c_nationkey')}, case when c_nationkey % 3 = 0 then '_list' else '' end, '.csv') as file,
  cast(floor(c_custkey / 9) as int) as position,
  case (c_custkey * 7 + c_nationkey) % {len(_NAMES)} {" ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES))} end as name,
  case c_custkey % 4 when 0 then '03-1234-5678' when 1 then 'a@b.jp' when 2 then '' else 'x' end as v1,
  case c_custkey % 5 when 0 then '０３１２３４５６７８９' when 1 then 'c@d.jp' when 2 then '' else 'y' end as v2
from {{customer}}
"""

FILES = f"""
select p_partkey as file_id,
  concat(case p_partkey % 4 when 0 then '20240131_' when 1 then '240131-' when 2 then '' else '202401 ' end,
    case p_partkey % 5 when 0 then '顧客一覧' when 1 then 'Ａｐｏ_List' when 2 then 'visit-log' when 3 then 'コピー' else '売上.見込' end,
    case p_partkey % 6 when 0 then '_最新版' when 1 then '_福岡' when 2 then '_東京_本社' when 3 then '_rev2' when 4 then concat('_', {_S.format('p_partkey % 3')}) else '' end,
    case p_partkey % 3 when 0 then '_20240201' when 1 then '' else '_final' end,
    case p_partkey % 3 when 0 then '.csv' when 1 then '.XLSX' else '.tsv' end) as name
from {{part}}
"""

CALLS = f"""
select event_id as row_index,
  case user_id % 6 when 0 then {_HYPHEN} when 1 then {_PHONE} when 2 then concat('+81', substring({_PHONE}, 2, 20)) when 3 then '' when 4 then '999' else concat('0800', {_pad('g % 1000000', 7)}) end as raw_phone,
  concat({_S.format('cast(year(ts) as int)')}, '-', {_pad('cast(month(ts) as int)', 2)}, '-', {_pad('cast(day(ts) as int)', 2)}) as call_date,
  concat('staff', {_S.format('user_id % 5')}) as call_staff,
  concat(event_type, ' ', {_S.format('cast(floor(value / 40) as bigint)')}) as content,
  event_type
from (select *, user_id as g from {{events}}) e
"""


# Tables of many short rows, of which normalising and comparing cost much more than reading, with their keys.
DENSE = {"customer": "c_custkey"}


def read(spark: SparkSession, sf_dir: str, name: str, dense: dict[str, str] = DENSE) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, dense[name]) if name in dense else df


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("customer", "orders", "events", "part", "pages", "documents", "lineitem") if "{" + n + "}" in sql]
    dense = DENSE | ({"orders": "o_orderkey"} if sql == FLOW else {})  # whose rows are normalised and identified
    return spark.sql(sql, **{n: read(spark, sf_dir, n, dense) for n in names})


def duck(sql: str) -> str:
    for n in ("customer", "orders", "events", "part", "pages", "documents", "lineitem"):
        sql = sql.replace("{" + n + "}", n)
    return sql

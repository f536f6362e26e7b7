"""Registered plans: result shaping, event de-dup, access gating, quality,
free SQL and bulk value resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import access as A
from quarry.operators import access as AO
from quarry.operators import events as E
from quarry.operators import quality as Q
from quarry.operators import results as P
from quarry.operators.resolve import bulk_resolve as _bulk
from quarry.operators.stored_result import store
from quarry.sources.sql import run_sql


def _read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_chunks(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return P.page(o, ["o_orderkey"]).select("o_orderkey", "rn", "chunk_id", "row_from", "row_to", "total")


def stored_pages(spark, sf_dir) -> DataFrame:
    """P1 on a stored result: the fourth and the last page of all orders by price, each from its own files."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    stored = store(o, ["o_totalprice", "o_orderkey"])
    pages = [3, stored.pages() - 1]
    return stored.page(pages[0]).unionByName(stored.page(pages[1])).select("rn", "o_orderkey")


def stripped_links(spark, sf_dir) -> DataFrame:
    """G4 for every request: file links only for callers of the download group."""
    r = _requests(spark, sf_dir).withColumn("can_download", A.can_download(A.group_ids("principal"), True, "HOUSEHOLD"))
    out = AO.strip_links(r.withColumn("files", F.array("filename", F.lit("index.csv"))), "files")
    return out.select("request_id", "can_download", F.array_join("files", ",").alias("links"))


def markdown_chunks(spark, sf_dir) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return P.markdown_chunks(c, ["c_custkey"])


def dedupe_chunks(spark, sf_dir) -> DataFrame:
    """P3 on message texts: first occurrence (by conversation, turn) of each text."""
    c = _read(spark, sf_dir, "conversations")
    return P.drop_repeats(c, "text", ["conv_id", "turn"])


def obsolescence(spark, sf_dir) -> DataFrame:
    """An obsolescence view (PartNumber, Status, Details) derived from ``part``."""
    p = _read(spark, sf_dir, "part")
    status = F.element_at(F.array(*[F.lit(s) for s in Q.STATUS_VALUES]),
                          (F.col("p_size") % 15 + 1).cast("int"))
    details = (F.when(F.col("p_type") == "PROMO", F.lit(None))
               .when(F.col("p_type") == "SMALL", F.lit("nan"))
               .when(F.col("p_type") == "LARGE", F.lit("   "))
               .otherwise(F.concat(F.lit("  "), F.col("p_name"))))
    return p.select(F.concat(F.lit("PN-"), F.col("p_partkey").cast("string")).alias("PartNumber"),
                    status.alias("Status"), details.alias("Details"))


def part_sentences(spark, sf_dir) -> DataFrame:
    o = obsolescence(spark, sf_dir)
    return o.select("PartNumber", P.status_sentence("PartNumber", "Status", "Details").alias("sentence"))


def status_answers(spark, sf_dir) -> DataFrame:
    """P4 per request: one request per status, brand and price."""
    o = obsolescence(spark, sf_dir).join(
        _read(spark, sf_dir, "part").select(F.concat(F.lit("PN-"), F.col("p_partkey").cast("string"))
                                            .alias("PartNumber"), "p_brand", "p_retailprice"),
        "PartNumber")
    s = o.withColumn("sentence", P.status_sentence("PartNumber", "Status", "Details"))
    return P.answer(s, ["Status", "p_brand", "p_retailprice"], "sentence")


def request_answers(spark, sf_dir) -> DataFrame:
    """P4, every outcome: each customer asks for the parts of a status, brand and type; over two rows make a file."""
    part = _read(spark, sf_dir, "part")
    o = obsolescence(spark, sf_dir).join(part.select(F.concat(F.lit("PN-"), F.col("p_partkey").cast("string"))
                                                     .alias("PartNumber"), "p_brand", "p_type"), "PartNumber")
    rows = o.withColumn("sentence", P.status_sentence("PartNumber", "Status", "Details"))
    k = F.col("c_custkey")
    asked = _read(spark, sf_dir, "customer").join(
        part.select((F.col("p_partkey") * 3).alias("c_custkey"), "p_brand", "p_type"), "c_custkey", "left").select(
        k.alias("request_id"), F.element_at(F.array(*[F.lit(s) for s in Q.STATUS_VALUES]), (k % 15 + 1).cast("int"))
        .alias("Status"), "p_brand", "p_type")
    return P.answer_requests(asked, rows, ["Status", "p_brand", "p_type"], "sentence", inline_limit=2).select(
        "request_id", "answer", "n_rows")


def consecutive_dedup(spark, sf_dir) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    return E.consecutive_dedup(ev, "user_id", ["ts", "event_id"], "event_type")


def message_dedup(spark, sf_dir) -> DataFrame:
    """E3 then E1 on conversation turns: blank texts skipped, repeated roles dropped."""
    c = E.skip_blank(_read(spark, sf_dir, "conversations"), "text")
    return E.consecutive_dedup(c, "conv_id", ["turn"], "role").select("conv_id", "turn", "role")


def _requests(spark, sf_dir) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    payload = F.to_json(F.struct(
        F.lit("aad").alias("auth_typ"),
        F.array(F.struct(F.lit("groups").alias("typ"), F.col("c_mktsegment").alias("val")),
                F.struct(F.lit("groups").alias("typ"),
                         F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("val")),
                F.struct(F.lit("name").alias("typ"), F.col("c_name").alias("val"))).alias("claims"),
        F.lit("name").alias("name_typ"), F.lit("roles").alias("role_typ")))
    header = (F.when(k % 7 == 0, F.lit("")).when(k % 7 == 1, F.lit("%% no base64 %%"))
              .otherwise(F.base64(F.encode(payload, "UTF-8"))))
    filename = F.when(k % 13 == 0, F.lit("../secret.csv")).otherwise(
        F.concat(F.lit("NATION_"), ((k * 7) % 30).cast("string"), F.lit(".csv")))
    path = (F.when(k % 3 == 0, F.lit("/api/chat")).when(k % 3 == 1, F.lit("/api/messages"))
            .otherwise(F.concat(F.lit(A.FILES_PREFIX), filename)))
    pid = F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("user-"), k.cast("string")))
    return c.select(k.alias("request_id"), path.alias("path"), pid.alias("principal_id"),
                    header.alias("principal"), filename.alias("filename"))


def decode_groups(spark, sf_dir) -> DataFrame:
    r = _requests(spark, sf_dir).withColumn("groups", A.group_ids("principal"))
    return r.select("request_id",
                    F.array_join(F.array_sort("groups"), ",").alias("groups_text"),
                    F.size("groups").alias("n_groups"),
                    A.can_download(F.col("groups"), True, "HOUSEHOLD").alias("can_download"))


def request_status(spark, sf_dir) -> DataFrame:
    listing = _read(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".csv")).alias("filename"))
    out = AO.request_status(_requests(spark, sf_dir), listing, True, "HOUSEHOLD")
    return out.select("request_id", "path", "status")


def enum_violations(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return Q.enum_violations(o, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


def status_violations(spark, sf_dir) -> DataFrame:
    """D1 with the canonical Status enum on the derived obsolescence view."""
    o = obsolescence(spark, sf_dir).withColumn(
        "Status", F.when(F.col("Details").isNull(), F.lower("Status")).otherwise(F.col("Status")))
    return Q.enum_violations(o, "Status", Q.STATUS_VALUES)


def status_distinct(spark, sf_dir) -> DataFrame:
    """A5: the canonical Status list with how many parts carry each value."""
    return Q.enum_counts(obsolescence(spark, sf_dir), "Status", Q.STATUS_VALUES)


def duplicate_keys(spark, sf_dir) -> DataFrame:
    return Q.duplicate_keys(_read(spark, sf_dir, "lineitem"), ["l_orderkey"])


SQL_TEXT = """
select c.c_mktsegment, o.o_orderpriority, count(*) as n_orders,
       round(sum(o.o_totalprice), 2) as revenue,
       cast(rank() over (partition by c.c_mktsegment order by count(*) desc, o.o_orderpriority)
            as bigint) as rnk
from orders o join customer c on o.o_custkey = c.c_custkey
group by c.c_mktsegment, o.o_orderpriority
"""


def sql_query(spark, sf_dir) -> DataFrame:
    return run_sql(spark, SQL_TEXT, {"orders": _read(spark, sf_dir, "orders"),
                                     "customer": _read(spark, sf_dir, "customer")})


def _needles(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return (p.select(F.col("p_type").alias("needle"))
            .unionByName(p.select(F.lower("p_type").alias("needle")))
            .unionByName(p.select(F.substring("p_type", 2, 100).alias("needle")))
            .unionByName(p.select(F.concat(F.lower("p_type"), F.lit("s")).alias("needle")))
            .unionByName(p.select(F.concat(F.lit("#"), F.col("p_size").cast("string")).alias("needle"))))


def bulk_resolve(spark, sf_dir) -> DataFrame:
    out = _bulk(_needles(spark, sf_dir), "needle", _read(spark, sf_dir, "part"), "p_type")
    return out.withColumn("score", F.round("score", 4))


QUERIES = {
    "page_chunks": page_chunks,
    "stored_pages": stored_pages,
    "stripped_links": stripped_links,
    "markdown_chunks": markdown_chunks,
    "dedupe_chunks": dedupe_chunks,
    "part_sentences": part_sentences,
    "status_answers": status_answers,
    "request_answers": request_answers,
    "consecutive_dedup": consecutive_dedup,
    "message_dedup": message_dedup,
    "decode_groups": decode_groups,
    "request_status": request_status,
    "enum_violations": enum_violations,
    "status_violations": status_violations,
    "status_distinct": status_distinct,
    "duplicate_keys": duplicate_keys,
    "sql_query": sql_query,
    "bulk_resolve": bulk_resolve,
}

_STATUS_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in Q.STATUS_VALUES) + "]"
_OBSOLESCENCE = f"""
select 'PN-' || p_partkey as PartNumber, {_STATUS_SQL}[(p_size % 15) + 1] as Status,
       case when p_type = 'PROMO' then null when p_type = 'SMALL' then 'nan'
            when p_type = 'LARGE' then '   ' else '  ' || p_name end as Details,
       p_brand, p_type, p_retailprice
from part"""
_SENTENCE = ("'Part ' || PartNumber || ' has a status of “' || Status || '”.' || "
             "case when trim(coalesce(Details, '')) <> '' and lower(trim(Details)) <> 'nan' "
             "then ' Additional details: ' || trim(Details) else '' end")
_REQ = """
select c_custkey as request_id, c_mktsegment, c_nationkey,
  case when c_custkey % 13 = 0 then '../secret.csv' else 'NATION_' || ((c_custkey * 7) % 30) || '.csv' end as filename,
  c_custkey % 3 as kind, c_custkey % 11 = 0 as no_principal, c_custkey % 7 in (0, 1) as bad_header
from customer"""

ORACLE = {
    "stored_pages": "select rn, o_orderkey from (select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) "
                    "as rn, count(*) over () as total from orders) "
                    "where (rn - 1) // 60 in (3, (total - 1) // 60)",
    "stripped_links": f"select request_id, (not bad_header and c_mktsegment = 'HOUSEHOLD') as can_download, "
                      f"case when not bad_header and c_mktsegment = 'HOUSEHOLD' then filename || ',index.csv' else '' end "
                      f"as links from ({_REQ})",
    "page_chunks": "select o_orderkey, rn, (rn - 1) // 60 as chunk_id, ((rn - 1) // 60) * 60 + 1 as row_from, "
                   "least(((rn - 1) // 60 + 1) * 60, total) as row_to, total from ("
                   "select o_orderkey, row_number() over (order by o_orderkey) as rn, "
                   "count(*) over () as total from orders)",
    "markdown_chunks": """
        with r as (select c_custkey, '| ' || c_custkey || ' | ' || coalesce(c_name, '') || ' | ' ||
                          coalesce(c_mktsegment, '') || ' |' as line,
                          row_number() over (order by c_custkey) as rn, count(*) over () as total
                   from customer)
        select (rn - 1) // 60 as chunk_id, min(rn) as row_from, max(rn) as row_to, any_value(total) as total,
               '**Rows ' || min(rn) || '–' || max(rn) || ' of ' || any_value(total) || '**' || chr(10) || chr(10) ||
               '| c_custkey | c_name | c_mktsegment |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
               string_agg(line, chr(10) order by rn) as body
        from r group by 1""",
    "dedupe_chunks": "select conv_id, turn, role, text from (select *, row_number() over "
                     "(partition by text order by conv_id, turn) as k from conversations) where k = 1",
    "part_sentences": f"select PartNumber, {_SENTENCE} as sentence from ({_OBSOLESCENCE})",
    "status_answers": f"""
        select Status, p_brand, p_retailprice,
               case when count(*) = 1 then min({_SENTENCE})
                    else count(*) || ' records match your request. The full results are shown below.' end as answer,
               count(*) as n_rows
        from ({_OBSOLESCENCE}) group by Status, p_brand, p_retailprice""",
    "request_answers": f"""
        with asked as (
          select c_custkey as request_id, {_STATUS_SQL}[(c_custkey % 15) + 1] as Status, p.p_brand, p.p_type
          from customer left join part p on p.p_partkey * 3 = c_custkey)
        select request_id, case when count(o.PartNumber) = 0 then 'No data was returned.'
            when count(o.PartNumber) = 1 then min({_SENTENCE})
            when count(o.PartNumber) > 2 then 'The requested file has been generated.'
            else count(o.PartNumber) || ' records match your request. The full results are shown below.' end as answer,
          count(o.PartNumber) as n_rows
        from asked a left join ({_OBSOLESCENCE}) o using (Status, p_brand, p_type) group by request_id""",
    "consecutive_dedup": "select event_id, ts, user_id, event_type, value, props from ("
                         "select *, lag(event_type) over (partition by user_id order by ts, event_id) as prev "
                         "from events) where prev is null or prev <> event_type",
    "message_dedup": "select conv_id, turn, role from (select *, lag(role) over (partition by conv_id "
                     "order by turn) as prev from conversations "
                     "where trim(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) <> '') "
                     "where prev is null or prev <> role",
    "decode_groups": f"select request_id, case when bad_header then '' else c_mktsegment || ',nation-' || "
                     f"c_nationkey end as groups_text, case when bad_header then 0 else 2 end as n_groups, "
                     f"(not bad_header and c_mktsegment = 'HOUSEHOLD') as can_download from ({_REQ})",
    "request_status": f"""
        select request_id, case kind when 0 then '/api/chat' when 1 then '/api/messages'
                                else '/api/files/' || filename end as path,
          case when kind <> 1 and no_principal then 401
               when kind = 2 and (bad_header or c_mktsegment <> 'HOUSEHOLD') then 403
               when kind = 2 and filename like '../%' then 403
               when kind = 2 and filename not in (select n_name || '.csv' from nation) then 404
               else 200 end as status
        from ({_REQ})""",
    "enum_violations": "select o_orderpriority, count(*) as n from orders where o_orderpriority is null "
                       "or o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1",
    "status_violations": f"select Status, count(*) as n from (select case when Details is null then "
                         f"lower(Status) else Status end as Status from ({_OBSOLESCENCE})) "
                         f"where not list_contains({_STATUS_SQL}, Status) group by 1",
    "status_distinct": f"select s.Status, count(o.Status) as n from (select unnest({_STATUS_SQL}) as Status) s "
                       f"left join ({_OBSOLESCENCE}) o on o.Status = s.Status group by s.Status",
    "duplicate_keys": "select l_orderkey, count(*) as n from lineitem group by 1 having count(*) > 1",
    "sql_query": SQL_TEXT,
    "bulk_resolve": """
        with n as (
          select p_type as needle, p_type as src, 'exact' as kind from part
          union all select lower(p_type), p_type, 'case' from part
          union all select substr(p_type, 2), p_type, 'fuzzy' from part
          union all select lower(p_type) || 's', p_type, 'fuzzy' from part
          union all select '#' || p_size, null, 'none' from part)
        select distinct needle, src as resolved, kind as match_kind,
          case kind when 'none' then null when 'fuzzy' then
            round(2.0 * least(length(needle), length(src)) / (length(needle) + length(src)), 4)
          else 1.0::double end as score
        from n""",
}

"""SQL twins of the adapters and of the operators' semantics, for checking
our Spark results against an independent engine (DuckDB dialect).

The expressions below restate the rules of ``salesledger.functions`` in
SQL: whitespace strip, title case, lenient number parsing, date layouts,
half-even rounding and exact money sums.
"""

from __future__ import annotations

from salesledger.functions.text import DEFAULT_NULL_TOKENS, PY_WHITESPACE

WS = "'" + PY_WHITESPACE.replace("'", "''") + "'"
NUMBER_RE = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in DEFAULT_NULL_TOKENS)
MONEY = "decimal(28,4)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def title(x: str) -> str:
    # runs of cased letters (RE2 has no Other_Lowercase/Other_Uppercase
    # classes; the twins' inputs hold none of those characters)
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, "
        "'([\\p{Lu}\\p{Ll}\\p{Lt}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}]+)', 1), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def untoken(x: str) -> str:
    return f"(case when {x} in ({TOKENS}) then null else {x} end)"


def num(x: str, default: str | None) -> str:
    s = strip(f"cast({x} as varchar)")
    parsed = f"(case when regexp_full_match({s}, {NUMBER_RE}) then try_cast({s} as double) end)"
    return parsed if default is None else f"coalesce({parsed}, {default})"


def int_num(x: str, default: int) -> str:
    return f"coalesce(try_cast(trunc({num(x, None)}) as bigint), {default})"


def parse_date(x: str) -> str:
    s = strip(x)
    return (
        f"cast(coalesce(try_strptime({s}, '%Y-%m-%d'), try_strptime({s}, '%Y-%m-%d %H:%M:%S'), "
        f"try_strptime({s}, '%m/%d/%Y')) as date)"
    )


def money_sum(x: str) -> str:
    return f"sum(cast({x} as {MONEY}))"


def share(part_double: str, total_exact: str, digits: int = 2) -> str:
    scale = float(10**digits)
    return (
        f"(case when {total_exact} > 0 then round_even({part_double} / cast({total_exact} as double) * 100.0 * {scale}, 0) "
        f"/ {scale} else 0.0 end)"
    )


LINE_ORDER = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
)

ORDER_REGION = """
order_region as (
  select o.o_orderkey, o.o_orderdate, o.o_totalprice, o.o_orderpriority, c.c_mktsegment, r.r_name
  from orders o
  join customer c on o.o_custkey = c.c_custkey
  join nation n on c.c_nationkey = n.n_nationkey
  join region r on n.n_regionkey = r.r_regionkey
)"""

SALES_ORDERS = (
    ORDER_REGION
    + """,
sales as (
  select cast(o_orderkey as varchar) as order_id, cast(o_orderdate as date) as date,
         o_orderpriority as product, c_mktsegment as category, cast(1 as bigint) as quantity,
         o_totalprice as unit_price, o_totalprice as revenue, r_name as region
  from order_region
)"""
)

LINES = (
    ORDER_REGION
    + """,
lines as (
  select l.*, orr.o_orderdate, orr.r_name, p.p_name, p.p_type
  from lineitem l
  join order_region orr on l.l_orderkey = orr.o_orderkey
  join part p on l.l_partkey = p.p_partkey
)"""
)

SALES_LINES = (
    LINES
    + """,
sales as (
  select cast(l_orderkey as varchar) as order_id, cast(o_orderdate as date) as date,
         p_name as product, p_type as category, cast(trunc(l_quantity) as bigint) as quantity,
         l_extendedprice / l_quantity as unit_price, l_extendedprice * (1.0 - l_discount) as revenue,
         r_name as region, """
    + LINE_ORDER
    + """
  from lines
)"""
)

MESSY = (
    LINES
    + """,
messy as (
  select
    case when l_tax = 0.0 and l_discount = 0.0 then null
         when l_tax = 0.08 and l_discount = 0.1 then 'N/A'
         when l_linenumber = 1 then ' ' || cast(l_orderkey as varchar) || ' '
         else cast(l_orderkey as varchar) end as order_id_raw,
    case when l_tax = 0.0 and l_discount = 0.03 then 'not a date'
         when l_linenumber = 2 then strftime(o_orderdate, '%m/%d/%Y')
         when l_linenumber = 3 then strftime(o_orderdate, '%Y-%m-%d') || ' 10:30:00'
         else strftime(o_orderdate, '%Y-%m-%d') end as date_raw,
    case when l_tax = 0.0 and l_discount = 0.05 then null
         when l_linestatus = 'F' and l_returnflag = 'A' then upper(p_name)
         when l_linestatus = 'O' and l_returnflag = 'N' then '  ' || p_name
         else p_name end as product_raw,
    case when l_tax = 0.0 and l_discount = 0.06 then null
         when l_returnflag = 'R' then lower(p_type)
         else p_type end as category_raw,
    case when l_tax = 0.0 and l_discount = 0.07 then 'many'
         when l_linenumber = 4 then ' ' || cast(cast(trunc(l_quantity) as bigint) as varchar) || ' '
         when l_linenumber = 5 then cast(l_quantity as varchar)
         else cast(cast(trunc(l_quantity) as bigint) as varchar) end as quantity_raw,
    case when l_tax = 0.0 and l_discount = 0.08 then null
         else cast(l_extendedprice / l_quantity as varchar) end as unit_price_raw,
    case when l_tax = 0.0 and l_discount = 0.01 then null
         when l_tax = 0.0 and l_discount = 0.02 then '$' || cast(l_extendedprice * (1.0 - l_discount) as varchar)
         when l_tax = 0.0 and l_discount = 0.09 then 'NA'
         else cast(l_extendedprice * (1.0 - l_discount) as varchar) end as revenue_raw,
    case when l_returnflag = 'R' then '  ' || lower(r_name) || ' '
         when l_tax = 0.0 and l_discount = 0.04 then 'N/A'
         else r_name end as region_raw,
    """
    + LINE_ORDER
    + """
  from lines
),
tok as (
  select """
    + ", ".join(
        f"{untoken(c + '_raw')} as {c}"
        for c in ("order_id", "date", "product", "category", "quantity", "unit_price", "revenue", "region")
    )
    + ", "
    + LINE_ORDER
    + """
  from messy
),
kept as (
  select """
    + strip("order_id")
    + """ as order_id, date,
         coalesce(product, 'Unknown Product') as product,
         coalesce(category, 'General') as category,
         quantity, unit_price, revenue,
         coalesce(region, 'Unknown Region') as region, """
    + LINE_ORDER
    + """
  from tok where order_id is not null and revenue is not null
),
firsts as (
  select * from kept
  qualify row_number() over (partition by order_id order by """
    + ", ".join(c.strip() + " nulls first" for c in LINE_ORDER.split(","))
    + """) = 1
),
cleaned as (
  select order_id, """
    + parse_date("date")
    + """ as date,
         """
    + title(strip("product"))
    + """ as product,
         """
    + title(strip("category"))
    + """ as category,
         """
    + int_num("quantity", 1)
    + """ as quantity,
         """
    + num("unit_price", "0.0")
    + """ as unit_price,
         """
    + num("revenue", "0.0")
    + """ as revenue,
         """
    + title(strip("region"))
    + """ as region
  from firsts
  where """
    + parse_date("date")
    + """ is not null
)"""
)

LEDGER = """
ledger as (
  select event_id as id, value as amount, event_type as category, props as description, cast(ts as date) as date
  from events
)"""

LEDGER_IMPORT = (
    LEDGER
    + """,
import_raw as (
  select
    case when value >= 400.0 then 'not a date'
         when event_type = 'view' then strftime(ts, '%m/%d/%Y')
         when event_type = 'click' and value < 5.0 then strftime(ts, '%Y-%m-%d %H:%M:%S')
         else strftime(ts, '%Y-%m-%d') end as date_raw,
    case when value >= 100.0 and value < 101.0 then null
         when event_type = 'purchase' and value < 10.0 then '  ' || upper(event_type) || ' '
         else event_type end as category_raw,
    case when value < 1.0 then 'free'
         when value >= 200.0 and value < 201.0 then '1,000'
         else cast(value as varchar) end as amount_raw,
    case when event_type = 'signup' and value < 20.0 then null
         when event_type = 'error' then ' ' || props || ' '
         else props end as description_raw,
    event_id as row_seq
  from events
),
imported as (
  select """
    + num(untoken("amount_raw"), "0.0")
    + """ as amount,
         """
    + title(strip(f"coalesce({untoken('category_raw')}, 'Nan')"))
    + """ as category,
         coalesce("""
    + strip(untoken("description_raw"))
    + """, '') as description,
         """
    + parse_date(untoken("date_raw"))
    + """ as date,
         row_seq
  from import_raw
  where """
    + parse_date(untoken("date_raw"))
    + """ is not null
),
numbered as (
  select (select coalesce(max(id), 0) from ledger) + row_number() over (order by row_seq) as id,
         amount, category, description, date
  from imported
)"""
)

CHANGES = """
changes as (
  select event_id as id, value * 2.0 as amount, ' Error Refund ' as category, props as description, cast(ts as date) as date
  from events where event_type = 'error'
  union all
  select event_id + 1000000000 as id, value as amount, 'Ghost' as category, cast(null as varchar) as description,
         cast(ts as date) as date
  from events where event_type = 'signup' and value >= 150.0
)"""


CHANGE_LOG = (
    CHANGES
    + """,
change_log as (
  select *, 1 as seq from changes
  union all
  select event_id, value - 20.0, 'Second Fix', cast(null as varchar), cast(ts as date), 2 from events where event_type = 'error'
),
last_valid as (
  select * from change_log where amount > 0 and category is not null and date is not null
  qualify row_number() over (partition by id order by seq desc) = 1
)"""
)

RATES = """
rates as (
  select * from (values ('INR', 1.0e0), ('USD', 0.012e0), ('EUR', 0.011e0), ('GBP', 0.0095e0), ('AED', 0.044e0),
                        ('SGD', 0.016e0), ('JPY', 1.88e0), ('CAD', 0.016e0)) as t(code, rate)
)"""

SPARSE = (
    MESSY
    + """,
sparse as (
  select order_id, """
    + parse_date("date")
    + """ as date, 'Unknown Product' as product, 'General' as category, cast(1 as bigint) as quantity,
         """
    + num("revenue", "0.0")
    + " as unit_price, "
    + num("revenue", "0.0")
    + """ as revenue, 'Unknown Region' as region
  from firsts
  where """
    + parse_date("date")
    + """ is not null
)"""
)


def json_fields(**fields: str) -> str:
    """A JSON object's text: name=kind, where kind is text, int or number."""
    parts = []
    for name, kind in fields.items():
        value = {
            "text": f"cast(to_json({name}) as varchar)",
            "int": f"cast({name} as varchar)",
            "number": f"cast(cast({name} as decimal(28,4)) as varchar)",
        }[kind]
        parts.append(f"'\"{name}\":' || coalesce({value}, 'null')")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def with_(*ctes: str) -> str:
    return "with " + ",".join(ctes) + "\n"

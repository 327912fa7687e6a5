"""SQL that DuckDB runs on the driver's tables to check the Spark jobs.

Written independently of the Spark code: plain joins, windows and exact
quantiles, without the steps that make the jobs scale.
"""

from __future__ import annotations

AS_OF = "2001-08-01"
STOCK_AS_OF = "2001-11-05"
KPI_DAYS = 365
PRODUCT_ID = 34
RULES = {"min_support": 0.005, "min_confidence": 0.05}
CATEGORY_RULES = {"min_support": 0.02, "min_confidence": 0.3}
ALL_DAYS = None
INSIGHT = {"min_lift": 1.0, "min_confidence": 0.3, "min_score": -0.5}
STORE_ID = 3

ROLES = {
    "customers": """
        select c_custkey customer_id, split_part(c_name,'#',1) first_name, split_part(c_name,'#',2) last_name,
               concat('c',cast(c_custkey as string),'@example.com') email, cast(null as string) phone,
               n_name city, r_name state
        from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    "products": """
        select p_partkey product_id, concat('SKU-',upper(substring(p_type,1,3)),'-',cast(p_partkey as string)) sku,
               p_name name, cast(null as string) description, p_type category, p_brand subcategory,
               round(p_retailprice/1.5,2) unit_cost, p_retailprice unit_price,
               15+p_size%36 reorder_point, cast(50+p_partkey%151 as int) reorder_quantity
        from part""",
    "stores": """
        select n_nationkey store_id, n_name name, r_name state
        from nation join region on n_regionkey=r_regionkey""",
    "staff": """
        select s_suppkey staff_id, s_nationkey store_id, split_part(s_name,'#',1) first_name,
               split_part(s_name,'#',2) last_name from supplier""",
    "transactions": """
        select o_orderkey transaction_id, c_nationkey store_id, o_custkey customer_id,
               case when o_orderkey%11=10 then null else o_orderkey%10 end staff_id,
               o_orderdate transaction_date, o_totalprice total_amount,
               case o_orderkey%3 when 0 then 'Cash' when 1 then 'Credit Card' else 'Debit Card' end payment_method
        from orders join customer on o_custkey=c_custkey""",
    "items": """
        select l_orderkey transaction_id, l_partkey product_id, cast(l_quantity as int) quantity,
               l_extendedprice/l_quantity unit_price, l_extendedprice total_price
        from lineitem""",
    "inventory": """
        select cast(s_nationkey as bigint)*1099511627776+l_partkey inventory_id, s_nationkey store_id,
               l_partkey product_id, cast(sum(l_quantity) as int)%201 quantity, max(l_shipdate) last_restocked
        from lineitem join supplier on l_suppkey=s_suppkey group by s_nationkey, l_partkey""",
}


def _with(roles: str, body: str, **ctes: str) -> str:
    parts = [f"{name} as ({ROLES[name]})" for name in roles.split()]
    parts += [f"{name} as ({sql})" for name, sql in ctes.items()]
    return f"with {', '.join(parts)} {body}"


def _days(later: str, earlier: str) -> str:
    return f"cast(floor(date_diff('microsecond', {earlier}, {later}) / 86400000000.0) as integer)"


def _money(x: str) -> str:
    return f"cast(sum(cast({x} as decimal(18,4))) as double)"


def _even(x: str, digits: int = 2) -> str:
    return f"cast(round_even(cast({x} as double), {digits}) as double)"


NOW = f"timestamp '{AS_OF}'"
STOCK_NOW = f"timestamp '{STOCK_AS_OF}'"

# -- customers -------------------------------------------------------------------

# Parameters (r, alpha, a, b) under which the customers' likelihood is compared.
VALUE_MODELS = [(1.0, 60.0, 0.8, 2.5), (0.3, 20.0, 2.0, 5.0), (5.0, 400.0, 0.1, 9.0)]

HISTORY = f"""
    select customer_id, count(distinct day) - 1 repeats, date_diff('day', min(day), max(day)) recency,
           date_diff('day', min(day), cast({NOW} as date)) age, {_money('total_amount')} / count(total_amount) average_order_value
    from (select *, cast(transaction_date as date) as day from transactions
          where customer_id is not null and transaction_date <= {NOW}) group by customer_id"""

RFM_WINDOW = f"""
    select customer_id, count(distinct transaction_id) frequency, {_money('total_amount')} monetary,
           {_days(NOW, 'max(transaction_date)')} recency
    from transactions
    where transaction_date >= {NOW} - interval 365 day and customer_id is not null
    group by customer_id"""

RFM_ALL = f"""
    select c.customer_id, c.first_name, c.last_name, count(t.transaction_id) frequency,
           coalesce({_money('t.total_amount')}, 0.0) monetary, max(t.transaction_date) last_purchase,
           coalesce({_days(NOW, 'max(t.transaction_date)')}, 365) recency
    from customers c left join transactions t on c.customer_id = t.customer_id
    group by all"""


def _edges(source: str) -> str:
    cols = ", ".join(
        f"quantile_cont(cast({m} as double), {p}) {m[0]}{i}, count(distinct {m}) {m[0]}n"
        if i == 1 else f"quantile_cont(cast({m} as double), {p}) {m[0]}{i}"
        for m in ("recency", "frequency", "monetary") for i, p in ((1, .25), (2, .5), (3, .75)))
    return f"select {cols} from {source}"


def _above(m: str) -> str:
    return " + ".join(f"cast({m} > {m[0]}{i} as integer)" for i in (1, 2, 3))


CODED = f"""
    select *, case when rfm_score in ('444','434','443','433') then 'Best Customers'
                   when r_score = 1 then 'Lost Customers'
                   when f_score = 4 and m_score = 4 then 'Loyal Customers'
                   when m_score = 4 then 'Big Spenders'
                   when f_score = 4 then 'Regular Customers'
                   else 'Average Customers' end segment
    from (select *, concat(r_score, f_score, m_score) rfm_score
          from (select customer_id, frequency, monetary, recency, 4 - ({_above('recency')}) r_score,
                       1 + ({_above('frequency')}) f_score, 1 + ({_above('monetary')}) m_score
                from rfm, edges))"""

SCORED = f"""
    select *, case when R = 4 and F = 4 and M = 4 then 'Best Customers'
                   when F = 4 and M = 4 then 'Loyal Customers'
                   when M = 4 then 'Big Spenders'
                   when R = 1 then 'Lost Customers'
                   when R = 4 then 'Recent Customers'
                   else 'Average Customers' end Segment
    from (select *, concat(R, F, M) RFM_Score
          from (select customer_id, first_name, last_name, frequency, monetary, last_purchase, recency,
                       case when rn < 4 then 2 else 4 - ({_above('recency')}) end R,
                       case when fn < 4 then 2 else 1 + ({_above('frequency')}) end F,
                       case when mn < 4 then 2 else 1 + ({_above('monetary')}) end M
                from rfm, edges))"""


def _coded(body: str) -> str:
    return _with("transactions", body, rfm=RFM_WINDOW, edges=_edges("rfm"), coded=CODED)


def _scored(body: str) -> str:
    return _with("customers transactions", body, rfm=RFM_ALL, edges=_edges("rfm"), scored=SCORED)


def _spread(shape) -> str:
    mean = {"monetary": f"{_money('monetary')} / count(monetary)"}
    return ", ".join(
        f"{shape(mean.get(m, f'avg({m})'))} {m}_mean, {shape(f'min({m})')} {m}_min, {shape(f'max({m})')} {m}_max"
        for m in ("recency", "frequency", "monetary"))


_TOTAL = _even("100.0 * count(*) / (select count(*) from {0})")

CUSTOMERS = {
    "rfm_metrics": _with("transactions", f"select * from ({RFM_WINDOW})"),
    "rfm_codes": _coded("select * from coded"),
    "rfm_code_summary": _coded(f"""
        select segment, {_even('avg(recency)')} avg_recency, {_even('avg(frequency)')} avg_frequency,
               {_even(_money('monetary') + ' / count(monetary)')} avg_monetary, count(*) count,
               {_TOTAL.format('coded')} percentage
        from coded group by segment"""),
    "segment_profile": _coded(f"""
        select segment, {_spread(lambda x: x)}, count(*) customer_id_count, {_TOTAL.format('coded')} percentage
        from coded group by segment"""),
    "customer_rfm": _scored("select * from scored"),
    "segment_summary": _scored(f"""
        select Segment, count(*) count, {_even('avg(recency)')} avg_recency, {_even('avg(frequency)')} avg_frequency,
               {_even(_money('monetary') + ' / count(*)')} avg_monetary, {_even(_money('monetary'))} total_monetary,
               {_TOTAL.format('scored')} percentage
        from scored group by Segment"""),
    "segment_stats": _scored(f"select Segment, {_spread(_even)} from scored group by Segment"),
    "segment_actions": _scored("""
        select s.Segment, cast(a.action_no as integer) action_no, a.action
        from (select distinct Segment from scored) s left join (values
            ('Lost Customers', 1, 'Re-engagement campaigns'), ('Lost Customers', 2, 'Special win-back offers'),
            ('Lost Customers', 3, 'Personalized communication'),
            ('At Risk Customers', 1, 'Loyalty program incentives'), ('At Risk Customers', 2, 'Targeted promotions'),
            ('At Risk Customers', 3, 'Customer feedback surveys'),
            ('Regular Customers', 1, 'Cross-selling opportunities'), ('Regular Customers', 2, 'Upselling campaigns'),
            ('Regular Customers', 3, 'Referral program'),
            ('Loyal Customers', 1, 'VIP treatment'), ('Loyal Customers', 2, 'Exclusive offers'),
            ('Loyal Customers', 3, 'Early access to new products'),
            ('Champions', 1, 'Brand ambassador program'), ('Champions', 2, 'Premium loyalty rewards'),
            ('Champions', 3, 'Co-creation opportunities')) a(Segment, action_no, action)
        on s.Segment = a.Segment"""),
    "customer_metrics": _with("transactions", f"""
        select customer_id, count(transaction_id) transaction_count, {_money('total_amount')} total_spent,
               {_money('total_amount')} / count(total_amount) average_transaction
        from transactions where customer_id is not null group by customer_id"""),
    "customer_summary": _with("customers transactions", f"""
        select c.customer_id, first_name, last_name, email, phone, count(t.transaction_id) total_transactions,
               {_money('t.total_amount')} total_spent
        from customers c left join transactions t on c.customer_id = t.customer_id group by all"""),
    "customer_value": _with("transactions", """
        select customer_id, aov average_order_value, orders * 365.0 / tenure orders_per_year,
               aov * (orders * 365.0 / tenure) * ((select avg(tenure) from c) / 365.0) lifetime_value
        from c""", c=f"""
        select customer_id, cast(count(*) as double) orders, {_money('total_amount')} / count(*) aov,
               greatest({_days(NOW, 'min(transaction_date)')}, 1) as tenure
        from transactions where customer_id is not null group by customer_id"""),
}
CUSTOMERS["purchase_history"] = _with("transactions", HISTORY)
CUSTOMERS["customer_value_likelihood"] = _with("transactions", """
    select model, round(sum(lgamma(r + repeats) - lgamma(r) + r * ln(alpha)
               + lgamma(a + b) + lgamma(b + repeats) - lgamma(b) - lgamma(a + b + repeats)
               + alive + ln(1 + case when repeats > 0 then exp(gone - alive) else 0 end)), 4) log_likelihood
    from (select *, -(r + repeats) * ln(alpha + age) alive,
                 ln(a) - ln(b + greatest(repeats, 1) - 1) - (r + repeats) * ln(alpha + recency) gone
          from history, models) group by model""", history=HISTORY,
    models="select * from (values " + ", ".join(
        f"(cast({i} as bigint), {', '.join(f'{x}::double' for x in m)})" for i, m in enumerate(VALUE_MODELS))
    + ") m(model, r, alpha, a, b)")
CUSTOMERS["load_customer_metrics"] = CUSTOMERS["customer_metrics"]
CUSTOMERS["load_customer_metrics_keyed"] = CUSTOMERS["customer_metrics"]

# -- sales -------------------------------------------------------------------------

EXTRACTED = """
    select transaction_id, transaction_date, total_amount, payment_method, c.customer_id, c.first_name, c.last_name,
           s.store_id, s.name store_name, f.staff_id, f.first_name staff_first_name, f.last_name staff_last_name
    from transactions t left join customers c on t.customer_id = c.customer_id
         left join stores s on t.store_id = s.store_id left join staff f on t.staff_id = f.staff_id
    where transaction_date <= timestamp '{0}'"""

LINES = """
    select t.transaction_id, t.transaction_date, t.customer_id, t.store_id, t.total_amount, i.product_id, i.quantity,
           i.unit_price from transactions t join items i on t.transaction_id = i.transaction_id"""

SNAPSHOT = f"""
    select inventory_id, store_id, i.product_id, cast(quantity as double) quantity, last_restocked, name product_name,
           category, unit_cost, unit_price, reorder_point, quantity * unit_cost total_value,
           {_days(STOCK_NOW, 'last_restocked')} days_since_restock,
           case when quantity <= reorder_point then 'Low Stock' else 'Adequate' end stock_status
    from inventory i join products p on i.product_id = p.product_id"""

_PERIODS = f"""
    select transaction_id, customer_id, total_amount,
           date_diff('day', cast(transaction_date as date), date '{AS_OF}') // {KPI_DAYS} period
    from transactions where cast(transaction_date as date) between date '{AS_OF}' - {3 * KPI_DAYS - 1} and date '{AS_OF}'"""


def _back(p: int) -> str:
    return f"""(select cast(count(distinct a.customer_id) as double) from p a join p b on a.customer_id = b.customer_id
                where a.period = {p} and b.period = {p + 1})
             / nullif((select count(distinct customer_id) from p where period = {p + 1}), 0)"""


def _kpi(name: str, value) -> str:
    return f"select '{name}' metric, cast({value(0)} as double) v, cast({value(1)} as double) w"


SALES = {
    "extract_transactions": _with("transactions customers stores staff", EXTRACTED.format(AS_OF)),
    "calendar_features": _with("transactions customers stores staff", f"""
        select *, dayname(transaction_date) day_of_week, monthname(transaction_date) "month",
               cast(hour(transaction_date) as integer) "hour"
        from ({EXTRACTED.format(AS_OF)})"""),
    "transaction_lines": _with("transactions items", LINES),
    "product_catalog": _with("products", "select * from products"),
    "product_list": _with("products", "select product_id, name, category from products"),
    "daily_sales_trend": _with("transactions", f"""
        select cast(transaction_date as date) "day", {_money('total_amount')} sales, count(*) orders
        from transactions group by 1"""),
    "kpis": _with("transactions items inventory", f"""
        select metric, round(v, 6) value, round(w, 6) previous, round((v - w) / nullif(v, 0) * 100, 6) change from (
        {_kpi('total_sales', lambda p: f"(select coalesce({_money('total_amount')}, 0) from p where period = {p})")}
        union all {_kpi('average_transaction',
                        lambda p: f"(select {_money('total_amount')} / count(*) from p where period = {p})")}
        union all {_kpi('retention_rate', _back)}
        union all {_kpi('inventory_turnover', lambda p: f'''
            (select sum(i.quantity) from items i join p on i.transaction_id = p.transaction_id where period = {p})
            / (select sum(quantity) from inventory)''')})""", p=_PERIODS),
    "store_performance": _with("transactions stores", f"""
        select store_id, store_name, state, sales, orders, sales / nullif(orders, 0) average_sale,
               round(sales / (sum(sales) over () / count(*) over ()), 6) performance
        from (select s.store_id, s.name store_name, s.state, coalesce({_money('t.total_amount')}, 0.0) sales,
                     count(t.transaction_id) orders
              from stores s left join transactions t on s.store_id = t.store_id
                   and transaction_date <= {NOW}
              group by all)"""),
    "extract_bundle": _with("transactions items inventory products customers", f"""
        select 'transaction_data' "name", count(*) "rows" from ({LINES})
        union all select 'inventory_data', count(*) from ({SNAPSHOT})
        union all select 'product_data', count(*) from products
        union all select 'customer_data', count(*) from customers"""),
}

# -- inventory -----------------------------------------------------------------------

METRICS = """
    select i.product_id, i.store_id, i.quantity, reorder_point, reorder_quantity, unit_cost, unit_price,
           quantity * unit_cost stock_value, quantity * unit_price potential_sales_value,
           case when quantity <= reorder_point then 'Low Stock' else 'Adequate' end stock_status
    from inventory i join products p on i.product_id = p.product_id"""


def _running(value: str) -> str:
    amount = f"cast({value} as decimal(18,4))"
    return (f"cast(sum({amount}) over (order by {value} desc, product_id, store_id rows unbounded preceding) as double)"
            f" cumulative_value, cast(sum({amount}) over () as double) total")


CLASSIFIED = f"""
    select *, case when cumulative_percentage > 0 and cumulative_percentage <= 80 then 'A'
                   when cumulative_percentage > 80 and cumulative_percentage <= 95 then 'B' else 'C' end abc_category
    from (select * exclude (total), {_even('cumulative_value / nullif(total, 0) * 100')} cumulative_percentage
          from (select *, {_running('total_value')}
                from (select p.product_id, name, category, unit_cost, unit_price, reorder_point, reorder_quantity,
                             quantity, store_id, unit_cost * quantity total_value,
                             unit_price * quantity potential_revenue, unit_price - unit_cost profit_margin
                      from products p join inventory i on p.product_id = i.product_id)))"""

HISTORY = f"""
    select i.product_id, i.quantity, t.transaction_date from items i join transactions t
    on i.transaction_id = t.transaction_id where t.transaction_date >= {NOW} - interval 1 year"""

_STD = """coalesce(sqrt(greatest(count(*) * cast(sum(quantity * quantity) as double)
          - cast(sum(quantity) as double) * cast(sum(quantity) as double), 0) / nullif(count(*) * (count(*) - 1.0), 0)), 0)"""
_STD_DAY = """sqrt(greatest(365 * cast(sum(q * q) as double) - cast(sum(q) as double) * cast(sum(q) as double), 0)
          / (365 * 364.0))"""
_PER_LINE = f"select product_id, avg(quantity) daily, {_STD} std from history group by 1"
_PER_DAY = f"""select product_id, cast(sum(q) as double) / 365 daily, {_STD_DAY} std from (
    select product_id, cast(transaction_date as date) d, sum(quantity) q from history group by 1, 2) group by 1"""
Z95 = "1.6448536269514715"

OPTIMIZED = f"""
    select i.product_id, i.store_id, i.quantity current_quantity,
           case when daily * 365 > 0 and unit_cost * 0.2 > 0
                then sqrt(2 * (daily * 365) * 50 / (unit_cost * 0.2::double)) else 0.0 end eoq,
           {Z95}::double * std * sqrt(7.0::double) safety_stock,
           daily * 7 + {Z95}::double * std * sqrt(7.0::double) reorder_point, p.reorder_point current_reorder_point
    from inventory i join products p on i.product_id = p.product_id join demand d on i.product_id = d.product_id"""


def _optimized(body: str, demand: str = _PER_LINE) -> str:
    return _with("inventory products items transactions", body, history=HISTORY, demand=demand, optimized=OPTIMIZED)


_OPT_OUT = """select product_id, store_id, current_quantity, round(eoq, 6) eoq, round(safety_stock, 6) safety_stock,
              round(reorder_point, 6) reorder_point, current_reorder_point from optimized"""

EXTRACTED_STOCK = """
    select inventory_id, store_id, i.product_id, quantity, last_restocked, name product_name, category, unit_cost,
           unit_price, reorder_point, reorder_quantity
    from inventory i join products p on i.product_id = p.product_id"""
TRANSFORMED = f"""
    select *, quantity * unit_cost stock_value, quantity * unit_price potential_sales_value,
           {_days(STOCK_NOW, 'last_restocked')} days_since_restock,
           case when quantity <= reorder_point then 'Low Stock' else 'Adequate' end stock_status,
           quantity / cast(reorder_quantity as double) turnover_rate
    from ({EXTRACTED_STOCK})"""

INVENTORY = {
    "inventory_metrics": _with("inventory products", METRICS),
    "abc_analysis": _with("inventory products", f"""
        select * exclude (total, cumulative_percentage), round(cumulative_percentage, 8) cumulative_percentage,
               case when cumulative_percentage <= 80 then 'A' when cumulative_percentage <= 95 then 'B'
                    else 'C' end abc_category
        from (select *, cumulative_value / nullif(total, 0) * 100 cumulative_percentage
              from (select *, {_running('stock_value')} from ({METRICS})))"""),
    "optimize_inventory": _optimized(_OPT_OUT),
    "optimize_inventory_by_day": _optimized(_OPT_OUT, _PER_DAY),
    "inventory_abc": _with("inventory products", CLASSIFIED),
    "abc_summary": _with("inventory products", f"""
        select l.abc_category, count(c.product_id) product_count, coalesce({_money('total_value')}, 0.0) total_value,
               cast(coalesce(sum(quantity), 0) as bigint) quantity,
               coalesce({_money('potential_revenue')}, 0.0) potential_revenue
        from (values ('A'), ('B'), ('C')) l(abc_category) left join c on l.abc_category = c.abc_category group by 1""",
                         c=CLASSIFIED),
    "sales_history": _with("items transactions", HISTORY),
    "inventory_actions": _optimized("""
        select product_id, store_id, action, current_quantity,
               round(case when action = 'Reorder' then eoq else reorder_point + safety_stock end, 6) recommended_quantity,
               round(reorder_point, 6) reorder_point
        from (select *, case when current_quantity <= reorder_point then 'Reorder'
                             when current_quantity > reorder_point * 2 then 'Reduce Stock' end action from optimized)
        where action is not null"""),
    "extract_inventory": _with("inventory products", EXTRACTED_STOCK),
    "transform_inventory": _with("inventory products", TRANSFORMED),
    "inventory_snapshot": _with("inventory products", SNAPSHOT),
    "stock_by_category": _with("inventory products", f"""
        select category, cast(sum(quantity) as bigint) quantity, {_money('total_value')} total_value
        from ({CLASSIFIED}) group by 1"""),
    "inventory_kpis": _with("inventory products", f"""
        select {_money('total_value')} total_value,
               cast(count(*) filter (where quantity <= reorder_point) as bigint) low_stock_count,
               avg(quantity) avg_stock from ({CLASSIFIED})"""),
    "low_stock_alerts": _with("inventory products", f"""
        select inventory_id, store_id, product_id, product_name, quantity, reorder_point,
               reorder_point - quantity shortfall from ({SNAPSHOT}) where quantity <= reorder_point"""),
    "product_metrics": _with("inventory products", f"""
        select product_id, {_money('stock_value')} stock_value, round(cast(sum(cast(turnover_rate as decimal(28,10))) as double) / count(turnover_rate), 6) turnover_rate
        from ({TRANSFORMED}) group by 1"""),
}

# -- recommendations -------------------------------------------------------------------


def _baskets(days: int) -> str:
    return f"""
        select t.transaction_id, i.product_id, p.name product_name, p.category
        from transactions t join items i on t.transaction_id = i.transaction_id
             join products p on i.product_id = p.product_id
        {f"where t.transaction_date >= {NOW} - interval {days} day" if days is not None else ""}"""


def _basket_query(body: str, days: int | None = 90, **ctes: str) -> str:
    return _with("transactions items products", body, baskets=_baskets(days), **ctes)


_NAMES = "select distinct transaction_id t, product_name x from baskets"
_SUPPORT = "select x, count(*) c from names group by 1"
_N = "select count(distinct transaction_id) n from baskets"
_PAIR_RULES = """
    select a antecedent, b consequent, together / cast(n as double) support, together / cast(sa.c as double) confidence,
           together * n / cast(sa.c * sb.c as double) lift
    from (select l.x a, r.x b, count(*) together from names l join names r on l.t = r.t and l.x <> r.x group by all)
         join support sa on sa.x = a join support sb on sb.x = b, total
    where together / cast(n as double) >= {min_support} and together / cast(sa.c as double) >= {min_confidence}"""
_RULE_CTES = {"names": _NAMES, "support": _SUPPORT, "total": _N, "rules": _PAIR_RULES.format(**RULES)}

_COUNTS = "select transaction_id t, product_id x, count(*) n from baskets group by all"
_COSINE = """
    select a, b, dot / sqrt(cast(na.s as double) * nb.s) score
    from (select l.x a, r.x b, sum(l.n * r.n) dot from counts l join counts r on l.t = r.t and l.x <> r.x group by all)
         join norms na on na.x = a join norms nb on nb.x = b"""
_COSINE_CTES = {"counts": _COUNTS, "norms": "select x, sum(n * n) s from counts group by 1", "cosine": _COSINE}
_TOP = "select * exclude (k) from (select *, row_number() over (partition by a order by score desc, b) k from {0}) where k <= {1}"

# Pearson from the dense transaction x category matrix, zeros included.
_CORR_CTES = {
    "cells": """
        select t, c, count(b.category) n
        from (select distinct transaction_id t from baskets) cross join (select distinct category c from baskets)
             left join baskets b on b.transaction_id = t and b.category = c group by all""",
    "corr_pairs": """
        select l.c a, r.c b, corr(cast(l.n as double), cast(r.n as double)) score
        from cells l join cells r on l.t = r.t group by all
        having l.c = r.c or sum(l.n * r.n) > 0"""}

_DESCRIBED = """
    select a product_id, pa.name product_name, pa.category, b {0}_product_id, pb.name {0}_product_name,
           pb.category {0}_category, together {1}
    from (select *, row_number() over (partition by a order by together desc, b) k from pairs) q
         join products pa on pa.product_id = a join products pb on pb.product_id = b
    where k <= {2}"""
_CO = """
    select l.product_id a, r.product_id b, count(distinct l.transaction_id) together
    from baskets l join baskets r on l.transaction_id = r.transaction_id and l.product_id <> r.product_id
    {0} group by all"""
_SHARED = """
    select l.product_id a, r.product_id b, count(distinct l.customer_id) together
    from bought l join bought r on l.customer_id = r.customer_id and l.product_id <> r.product_id
    {0} group by all"""
_BOUGHT = """
    select distinct t.customer_id, i.product_id from items i join transactions t on i.transaction_id = t.transaction_id
    join products p on i.product_id = p.product_id"""
_ONE = f"where l.product_id = {PRODUCT_ID}"

# Rules over product names. No four names are ever frequent together here, so
# itemsets of one to three names are all there are.
_NAME_SET_CTES = {
    "names": _NAMES,
    "name_sets": """
        select x w, 1 k, count(*) c from names group by 1
        union all select concat(a.x, '|', b.x), 2, count(*) from names a join names b on a.t = b.t and a.x < b.x group by 1
        union all select concat(a.x, '|', b.x, '|', c.x), 3, count(*)
        from names a join names b on a.t = b.t and a.x < b.x join names c on b.t = c.t and b.x < c.x group by 1""",
    "frequent": """
        select string_split(w, '|') l, w, k, c, n from name_sets, (""" + _N + """)
        where c / cast(n as double) >= {min_support}""".format(**RULES),
    "set_rules": """
        select a.w antecedents, c.w consequents, a.c / cast(u.n as double) antecedent_support,
               c.c / cast(u.n as double) consequent_support, u.c / cast(u.n as double) support,
               u.c / cast(a.c as double) confidence, u.c * u.n / cast(a.c * c.c as double) lift
        from (select * from frequent where k > 1) u join frequent a on list_has_all(u.l, a.l) and a.k < u.k
             join frequent c on list_has_all(u.l, c.l) and c.k = u.k - a.k
        where u.c / cast(a.c as double) >= {min_confidence}
          and list_sort(list_concat(a.l, c.l)) = u.l
        """.format(**RULES)}

# Every itemset of categories as a bit mask; a basket holds it if no bit is missing.
_SET_CTES = {
    "bits": """select category, row_number() over (order by category) - 1 k
               from (select distinct category from baskets)""",
    "masks": """select transaction_id, cast(sum(1 << k) as bigint) m
                from (select distinct transaction_id, category from baskets) join bits using (category) group by 1""",
    "sets": """select s, count(*) c from range(1, (select cast(1 << count(*) as bigint) from bits)) r(s)
               join masks on m & s = s group by 1""",
    "words": """select s, string_agg(category, '|' order by category) w
                from range(1, (select cast(1 << count(*) as bigint) from bits)) r(s)
                join bits on (s >> k) & 1 = 1 group by 1""",
    "set_rules": """
        select wa.w antecedents, wc.w consequents, a.c / cast(n as double) antecedent_support,
               c.c / cast(n as double) consequent_support, u.c / cast(n as double) support,
               u.c / cast(a.c as double) confidence, u.c * n / cast(a.c * c.c as double) lift
        from sets u join sets a on a.s & u.s = a.s and a.s <> u.s join sets c on c.s = u.s - a.s
             join words wa on wa.s = a.s join words wc on wc.s = c.s, (""" + _N + """)
        where u.c / cast(n as double) >= {min_support} and u.c / cast(a.c as double) >= {min_confidence}
        """.format(**CATEGORY_RULES)}

RECOMMEND = {
    "basket_lines": _with("transactions items products", _baskets(90)),
    "pair_rules": _basket_query(
        "select antecedent, consequent, round(support, 8) support, round(confidence, 8) confidence, round(lift, 8) lift from rules",
        ALL_DAYS, **_RULE_CTES),
    "association_rules": _basket_query("""
        select antecedents, consequents, round(antecedent_support, 8) antecedent_support,
               round(consequent_support, 8) consequent_support, round(support, 8) support,
               round(confidence, 8) confidence, round(lift, 8) lift from set_rules""", ALL_DAYS, **_SET_CTES),
    "product_name_rules": _basket_query("""
        select antecedents, consequents, round(antecedent_support, 8) antecedent_support,
               round(consequent_support, 8) consequent_support, round(support, 8) support,
               round(confidence, 8) confidence, round(lift, 8) lift from set_rules""", ALL_DAYS, **_NAME_SET_CTES),
    "rule_edges": _basket_query("""
        select source, unnest(string_split(consequents, '|')) target, round(lift, 8) "value"
        from (select unnest(string_split(antecedents, '|')) source, consequents, lift from set_rules)""",
                                ALL_DAYS, **_SET_CTES),
    "item_cosine": _basket_query("select a, b, round(score, 8) score from cosine", **_COSINE_CTES),
    "similar_products": _basket_query(
        f"select a, b, round(score, 8) score from ({_TOP.format('cosine', 5)})", **_COSINE_CTES),
    "similar_to": _basket_query(
        f"select a, b, round(score, 8) score from ({_TOP.format('cosine', 5)}) where a = {PRODUCT_ID}",
        **_COSINE_CTES),
    "category_correlation": _basket_query("select a, b, round(score, 8) score from corr_pairs", **_CORR_CTES),
    "category_correlation_full": _basket_query(
        """select l.c a, r.c b, round(corr(cast(l.n as double), cast(r.n as double)), 8) score
           from cells l join cells r on l.t = r.t group by all""", cells=_CORR_CTES["cells"]),
    "product_lookup": _with("products", f"""
        select product_id, name product_name, category from products where product_id = {PRODUCT_ID}"""),
    "bought_together": _basket_query(
        _DESCRIBED.format("related", "co_purchase_count", 5), 90, pairs=_CO.format(_ONE)),
    "bought_together_all": _basket_query(
        _DESCRIBED.format("related", "co_purchase_count", 5), 90, pairs=_CO.format("")),
    "shared_customers": _with("items transactions products", _DESCRIBED.format("similar", "common_customers", 10),
                              bought=_BOUGHT, pairs=_SHARED.format(_ONE)),
    "shared_customers_all": _with("items transactions products", _DESCRIBED.format("similar", "common_customers", 10),
                                  bought=_BOUGHT, pairs=_SHARED.format("")),
    "category_performance": _with("items transactions products", f"""
        select category, count(distinct t.transaction_id) transaction_count,
               cast(sum(quantity) as bigint) total_quantity, {_money('quantity * i.unit_price')} total_revenue,
               count(distinct p.product_id) product_count,
               {_money('quantity * i.unit_price')} / count(distinct t.transaction_id) avg_revenue_per_transaction
        from items i join transactions t on i.transaction_id = t.transaction_id
             join products p on i.product_id = p.product_id
        where t.transaction_date >= {NOW} - interval 90 day group by 1"""),
    "recommendation_insights": _basket_query("""
        select strong_rules, strong_category_pairs,
               case when strong_rules > 0 then concat('Found ', strong_rules,
                    ' strong product associations for cross-selling') end rule_insight,
               case when strong_category_pairs > 0 then concat('Identified ', strong_category_pairs,
                    ' strong category relationships') end category_insight
        from (select (select count(*) from set_rules where lift > {min_lift} and confidence > {min_confidence}) strong_rules,
                     (select count(*) from corr_pairs where a < b and score > {min_score}) strong_category_pairs)
        """.format(**INSIGHT), ALL_DAYS, **_SET_CTES, **_CORR_CTES),
    "recommendation_strategies": _basket_query("""
        select * from (select 'Cross-selling' type, 'Bundle frequently co-purchased products' description,
               replace(antecedents, '|', ', ') a, replace(consequents, '|', ', ') b, round(lift, 8) score from set_rules where lift > {min_lift}
               order by lift desc, a, b limit 5)
        union all
        select * from (select 'Category-based', 'Promote complementary categories together', a, b, round(score, 8)
               from corr_pairs where a < b and score > {min_score} order by score desc, a, b limit 5)
        """.format(**INSIGHT), ALL_DAYS, **_SET_CTES, **_CORR_CTES),
}

# -- forecasts ---------------------------------------------------------------------------

PERIODS = 30
Z975 = "1.9599639845400536::double"
Z90 = "1.2815515655446008::double"

_SERIES = {
    "sold": """
        select p.category series_id, cast(t.transaction_date as date) ds, sum(i.quantity) q
        from items i join transactions t on i.transaction_id = t.transaction_id
             join products p on i.product_id = p.product_id group by all""",
    "grid": f"""
        select s.series_id, cast(d as date) ds
        from (select distinct series_id from sold) s,
             generate_series((select cast(min(transaction_date) as date) from transactions), date '{AS_OF}',
                             interval 1 day) g(d)""",
    "series": """
        select grid.series_id, grid.ds, cast(coalesce(q, 0) as double) y
        from grid left join sold on sold.series_id = grid.series_id and sold.ds = grid.ds""",
}
_CONDITIONED = {
    "lifted": """
        select series_id, ds, case when y = 0 then 0.1 * m else y end y
        from series join (select series_id, coalesce(min(y) filter (where y > 0), 1) m from series group by 1)
             using (series_id)""",
    "conditioned": """
        select series_id, ds, greatest(least(y, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) y
        from lifted join (select series_id, quantile_cont(y, 0.25) q1, quantile_cont(y, 0.75) q3
                          from lifted group by 1) using (series_id)""",
}
_PARTS = {
    "parts": """
        select series_id, ds, y, case when rn <= case when floor(n * 0.8) >= 14 then floor(n * 0.8)
                                                      when n > 7 then n - 7 else n end then 'train' else 'test' end part
        from (select *, row_number() over (partition by series_id order by ds) rn,
                     count(*) over (partition by series_id) n from conditioned)""",
}


def _model(parts: str, op: str, weekly: bool, monthly: bool, z: str) -> dict[str, str]:
    """The closed-form model, one common table per effect."""
    out = "/" if op == "*" else "-"
    one = "1.0" if op == "*" else "0.0"
    trend = "greatest(level + slope * t, 1e-9)" if op == "*" else "level + slope * t"

    def effect(source: str, name: str, slot: str) -> str:
        return f"""
            select {source}.*, coalesce(e, {one}) {name}, {source}.left_over {out} coalesce(e, {one}) rest
            from {source} left join (select series_id, {slot} slot, avg(left_over) e from {source}
                                     where part = 'train' group by all) x
                 on x.series_id = {source}.series_id and x.slot = {slot.replace('ds', source + '.ds')}"""

    ctes = {
        "extended": f"""
            select * from {parts} union all
            select series_id, cast(d as date), null, 'future'
            from generate_series(date '{AS_OF}' + 1, date '{AS_OF}' + {PERIODS}, interval 1 day) g(d),
                 (select distinct series_id from {parts})""",
        "timed": """select series_id, ds, part, y, cast(date_diff('day', s, ds) as double) t
                    from extended join (select series_id, min(ds) s from extended group by 1) using (series_id)""",
        "lines": """select series_id, regr_slope(y, t) slope, regr_intercept(y, t) level
                    from timed where part = 'train' group by 1""",
        "m0": f"""select series_id, ds, part, y, {trend} trend, y {out} ({trend}) left_over
                  from timed join lines using (series_id)""",
        "w1": effect("m0", "weekly", "dayofweek(ds)"),
        "m1": "select * exclude (left_over, rest), rest left_over from w1",
        "w2": effect("m1", "yearly", "month(ds)"),
        "m2": "select * exclude (left_over, rest), rest left_over from w2",
    }
    if monthly:
        ctes["w3"] = effect("m2", "monthly", "dayofmonth(ds)")
    else:
        ctes["w3"] = f"select *, cast({one} as double) monthly from m2"
    ctes["m3"] = f"select series_id, ds, part, y, trend, weekly, yearly, monthly, trend {op} weekly {op} yearly {op} monthly yhat from w3"
    ctes["forecast"] = f"""
        select m3.*, yhat - {z} * s yhat_lower, yhat + {z} * s yhat_upper
        from m3 join (select series_id, stddev_samp(y - yhat) s from m3 where part = 'train' group by 1) using (series_id)"""
    return ctes


def _forecast_query(body: str, *steps: dict[str, str]) -> str:
    ctes = {name: sql for step in steps for name, sql in step.items()}
    return _with("transactions items products", body, **ctes)


_MULTI = (_SERIES, _CONDITIONED, _PARTS, _model("parts", "*", True, True, Z975))
_ADD = (_SERIES, {"plain": "select series_id, ds, y, 'train' part from series"}, _model("plain", "+", True, False, Z90))
_FORECAST_COLS = ", ".join(
    f"round({c}, 4) {c}" for c in ("y", "trend", "weekly", "yearly", "monthly", "yhat", "yhat_lower", "yhat_upper"))
_ACCURACY = """
    select series_id, count(*) test_days, avg(abs(y - yhat)) mae, avg(abs((y - yhat) / nullif(y, 0))) * 100 mape,
           sqrt(avg((y - yhat) * (y - yhat))) rmse,
           case when var_pop(y) > 0 then 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*))
                when sum((y - yhat) * (y - yhat)) < 1e-18 then 1.0 else 0.0 end r2
    from forecast where part = 'test' group by 1"""
_PATTERNS = """
    select series_id, 'yearly' pattern, cast(month(ds) as integer) "position", monthname(ds) "label", avg(yearly) v
    from forecast group by all
    union all select series_id, 'weekly', cast(dayofweek(ds) + 1 as integer), dayname(ds), avg(weekly)
    from forecast group by all
    union all select series_id, 'monthly', cast(dayofmonth(ds) as integer), cast(dayofmonth(ds) as varchar), avg(monthly)
    from forecast group by all"""

FORECAST = {
    "daily_demand": _with("transactions items products", f"""
        select g.series_id, g.ds, cast(coalesce(q, 0) as double) y
        from (select s.series_id, cast(d as date) ds from (select distinct series_id from sold) s,
                     generate_series(date '{AS_OF}' - 365, date '{AS_OF}', interval 1 day) r(d)) g
             left join sold on sold.series_id = g.series_id and sold.ds = g.ds""",
                          sold=f"""
        select cast(i.product_id as varchar) series_id, cast(t.transaction_date as date) ds, sum(i.quantity) q
        from items i join transactions t on i.transaction_id = t.transaction_id
        where t.transaction_date >= {NOW} - interval 365 day group by all"""),
    "daily_demand_since_start": _forecast_query("select * from series", _SERIES),
    "condition_series": _forecast_query("select series_id, ds, round(y, 6) y from conditioned", _SERIES, _CONDITIONED),
    "train_test_split": _forecast_query(
        "select series_id, ds, round(y, 6) y, part from parts", _SERIES, _CONDITIONED, _PARTS),
    "seasonal_trend_forecast": _forecast_query(
        f"select series_id, ds, part, {_FORECAST_COLS} from forecast", *_MULTI),
    "forecast_view": _forecast_query(f"""
        select series_id, ds, round(yhat, 4) yhat, round(yhat_lower, 4) yhat_lower, round(yhat_upper, 4) yhat_upper,
               round(trend, 4) trend, part, case when ds <= date '{AS_OF}' then 'Historical' else 'Forecast' end "view"
        from forecast""", *_MULTI),
    "forecast_additive": _forecast_query(f"select series_id, ds, part, {_FORECAST_COLS} from forecast", *_ADD),
    "forecast_accuracy": _forecast_query(f"""
        select series_id, test_days, round(mae, 4) mae, round(mape, 4) mape, round(rmse, 4) rmse, round(r2, 4) r2,
               cast(null as varchar) error from ({_ACCURACY})""", *_MULTI),
    "forecast_error_table": _forecast_query("""
        select f.series_id, f.ds, round(yhat, 4) yhat, round(yhat_lower, 4) yhat_lower,
               round(yhat_upper, 4) yhat_upper, s.y, round(s.y - yhat, 4) error, round(abs(s.y - yhat), 4) absolute_error,
               round((s.y - yhat) / nullif(s.y, 0) * 100, 4) percentage_error
        from forecast f left join series s on s.series_id = f.series_id and s.ds = f.ds""", *_MULTI),
    "forecast_error_summary": _forecast_query("""
        select f.series_id, round(avg(abs(s.y - yhat)), 4) mae,
               round(avg(abs((s.y - yhat) / nullif(s.y, 0))) * 100, 4) mape,
               round(sqrt(avg((s.y - yhat) * (s.y - yhat))), 4) rmse
        from forecast f left join series s on s.series_id = f.series_id and s.ds = f.ds group by 1""", *_MULTI),
    "seasonal_patterns": _forecast_query(
        f'select series_id, pattern, "position", "label", round(v, 6) "value" from ({_PATTERNS})', *_MULTI),
    "forecast_advice": _forecast_query(f"""
        select series_id, unnest(list_filter([
            case when change > 1.1 then 'Consider increasing inventory levels'
                 when change < 0.9 then 'Consider reducing inventory levels' end,
            case when week_std > 0.5 then 'Implement dynamic pricing based on weekly patterns' end,
            case when mape > 20 then 'Review and adjust forecasting model parameters' end],
            lambda x: x is not null)) advice
        from (select series_id, max_by(trend, ds) / min_by(trend, ds) change from forecast group by 1)
             join (select series_id, stddev_samp(v) week_std from ({_PATTERNS}) where pattern = 'weekly' group by 1)
                  using (series_id)
             join ({_ACCURACY}) using (series_id)""", *_MULTI),
}

# One product, and all products: mostly zero days, so outliers stay.
_PRODUCT_SERIES = _SERIES | {"sold": """
    select cast(i.product_id as varchar) series_id, cast(t.transaction_date as date) ds, sum(i.quantity) q
    from items i join transactions t on i.transaction_id = t.transaction_id {0} group by all"""}
_UNCLIPPED = {"lifted": _CONDITIONED["lifted"], "conditioned": "select series_id, ds, y from lifted"}


def _product_query(body: str, where: str = "") -> str:
    return _forecast_query(body, _PRODUCT_SERIES | {"sold": _PRODUCT_SERIES["sold"].format(where)}, _UNCLIPPED, _PARTS,
                           _model("parts", "*", True, True, Z975))


_OF_ONE = f"where i.product_id = {PRODUCT_ID}"
FORECAST |= {
    "daily_demand_product": _forecast_query(
        "select * from series", _PRODUCT_SERIES | {"sold": _PRODUCT_SERIES["sold"].format(_OF_ONE)}),
    "product_forecast": _product_query(f"select series_id, ds, part, {_FORECAST_COLS} from forecast", _OF_ONE),
    "product_forecast_accuracy": _product_query(FORECAST["forecast_accuracy"][FORECAST["forecast_accuracy"].rindex(
        # Of a hopeless series the last decimals of r2 depend on the order of addition.
        "select series_id, test_days"):].replace("round(r2, 4)", "case when abs(r2) > 1e6 then round(r2, -4) else round(r2, 4) end")),
    "product_forecast_advice": _product_query(FORECAST["forecast_advice"][FORECAST["forecast_advice"].rindex(
        "select series_id, unnest(list_filter"):]),
    "product_seasonal_patterns": _product_query(
        f'select series_id, pattern, "position", "label", round(v, 6) "value" from ({_PATTERNS})'),
    "product_future_forecast": _product_query(
        f"select series_id, ds, {_FORECAST_COLS.removeprefix('round(y, 4) y, ')} from forecast where part = 'future'"),
    # What the fit leaves has nothing in common with what it could use.
    "fourier_normal_equations": _forecast_query("""
        select series_id, count(*) filter (part = 'train') train_days, count(*) filter (part = 'test') test_days,
               count(*) filter (part = 'future') future_days, 0.0::double residual from extended group by 1""", *_MULTI[:3], {
        "extended": _model("parts", "*", True, True, Z975)["extended"]}),
}
_APART = "((r - c.r) / sr) * ((r - c.r) / sr) + ((f - c.f) / sf) * ((f - c.f) / sf) + ((m - c.m) / sm) * ((m - c.m) / sm)"
_ALL_APART = f"list_transform(centres, lambda c: {_APART})"
_CENTRE = "{'r': sum(x.r) / count(*), 'f': sum(x.f) / count(*), 'm': cast(sum(x.exact) as double) / count(*)}"


def _rounds(first: str, points: str, most: int, move: str) -> str:
    return f"""
        select 0 i, ({first}) centres, 1.0::double moved
        union all
        select i + 1, next, case when len(next) <> len(centres) then 1 else list_max(list_transform(range(1, len(next) + 1), lambda j:
                   pow((next[j].r - centres[j].r) / sr, 2) + pow((next[j].f - centres[j].f) / sf, 2) + pow((next[j].m - centres[j].m) / sm, 2))) end
        from (select i, centres, list(centre order by number) next
              from (select i, centres, number, {_CENTRE} centre
                    from (select steps.i, centres, r, f, m, exact, list_position({_ALL_APART}, list_min({_ALL_APART})) number
                          from {{0}} steps, {points}, scale where steps.i < {most} and moved > {move}) x
                    group by i, centres, number)
              group by i, centres), scale"""


CUSTOMERS["customer_kmeans"] = _with("transactions", f"""
    select customer_id, recency, frequency, monetary,
           cast(list_position({_ALL_APART}, list_min({_ALL_APART})) - 1 as integer) "cluster"
    from (select list_sort(centres) centres from rounds order by i desc limit 1), points, scale""",
    rfm=RFM_WINDOW, points="""
        select *, cast(recency as double) r, cast(frequency as double) f, cast(monetary as double) m,
               cast(monetary as decimal(18, 4)) exact from rfm""",
    scale="select round(stddev_samp(r), 6) sr, round(stddev_samp(f), 6) sf, round(stddev_samp(m), 6) sm from points",
    picked="""
        select points.* from points, (select count(*) n from points)
        where cast('0x' || substr(md5(cast(customer_id as varchar)), 1, 13) as bigint) / 4503599627370496.0 * n < 2048""",
    start=f"""
        select 1 k, [{_CENTRE}] centres from points x
        union all
        select k + 1, list_append(centres, arg_max({{'r': r, 'f': f, 'm': m}}, {{'d': list_min({_ALL_APART}), 'i': -customer_id}}))
        from start, picked, scale where k < 4 group by k, centres""",
    near=_rounds("select centres from start where k = 4", "picked", 300, "1e-6").replace("{0}", "near"),
    rounds=_rounds("select centres from near order by i desc limit 1", "points", 40, "1e-4").replace("{0}", "rounds")
).replace("with ", "with recursive ", 1)
CUSTOMERS["kmeans_summary"] = _with("transactions", f"""
    select count(*) customers, 4::bigint clusters, 0::bigint nearer_to_another, 0.0::double centre_error,
           round(avg(recency), 6) mean_recency, round(avg(frequency), 6) mean_frequency from rfm""", rfm=RFM_WINDOW)
SALES |= {
    "kpis_of_days": SALES["kpis"],
    "table_probe": _with("transactions items products", """
        select 'transactions' name, exists (select * from transactions) has_rows
        union all select 'items', exists (select * from items) union all select 'products', exists (select * from products)
        union all select 'none', exists (select * from products where product_id is null)"""),
    "bundle_transaction_data": SALES["transaction_lines"], "bundle_inventory_data": INVENTORY["inventory_snapshot"],
    "bundle_product_data": SALES["product_catalog"], "bundle_customer_data": CUSTOMERS["customer_summary"],
    "load_product_metrics": INVENTORY["product_metrics"],
}
INVENTORY["inventory_metrics_of_store"] = _with("inventory products", f"select * from ({METRICS}) where store_id = {STORE_ID}")

# Days are handed over as timestamps: engines give plain dates to Python differently.
_DAY_COLUMNS = {"daily_sales_trend": "day"} | {
    name: "ds" for name in FORECAST
    if name not in ("forecast_accuracy", "forecast_error_summary", "seasonal_patterns", "forecast_advice",
                    "product_forecast_accuracy", "product_forecast_advice", "product_seasonal_patterns", "fourier_normal_equations")}

ORACLES: dict[str, str] = {
    name: f'select * replace (cast("{_DAY_COLUMNS[name]}" as timestamp) as "{_DAY_COLUMNS[name]}") from ({sql})'
    if name in _DAY_COLUMNS else sql
    for name, sql in {**CUSTOMERS, **SALES, **INVENTORY, **RECOMMEND, **FORECAST}.items()}

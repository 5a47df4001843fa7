"""Common table expressions shared by the SQL statements."""

SPACE = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]"

VIEWS = {
    "ticket_history": """
select o_orderkey as ticket_key,
       case when o_orderkey % 1000 = 0 then 'Security'
            when c_mktsegment = 'AUTOMOBILE' then 'Technical'
            when c_mktsegment = 'BUILDING'   then 'Billing'
            when c_mktsegment = 'MACHINERY'  then 'Fraud'
            when c_mktsegment = 'HOUSEHOLD'  then 'Account'
            else 'General Inquiry' end as Issue_Category,
       case o_orderstatus when 'O' then 'Chat' when 'F' then 'Email' else 'Web Form' end as Ticket_Channel,
       case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'High'
            when '3-MEDIUM' then 'Medium' when '5-LOW' then 'Low' end as Priority_Level,
       cast(o_orderdate as timestamp) as Submission_Date,
       case when o_orderkey % 50 = 7 then null else o_totalprice % 120 end as Resolution_Time_Hours
from orders join customer on o_custkey = c_custkey""",
    "ticket_text": """
select d.doc_id as ticket_key,
       case when d.doc_id % 10 = 3 then null else d.text end as Ticket_Subject,
       d.text as Ticket_Description,
       case cast(substr(d.source, 4) as int) % 7 when 0 then 'Technical' when 1 then 'Billing' when 2 then 'Fraud'
            when 3 then 'Account' when 4 then 'General Inquiry' when 5 then 'Other' end as Issue_Category,
       case d.lang when 'en' then 'Email' when 'fr' then 'Chat' when 'de' then 'Web Form' end as Ticket_Channel,
       case when l.quality = 0 and l.toxic = 1 then 'Critical' when l.quality = 0 then 'High'
            when l.quality = 1 and l.toxic = 1 then 'Medium' when l.quality = 1 then 'Low' end as Priority_Level
from documents d left join labels l on d.doc_id = l.doc_id""",
    "ticket_html": """
select page_id as ticket_key, html as Ticket_Description, url as Ticket_Subject from pages""",
    "ticket_thread": """
select conv_id as ticket_key, text as Ticket_Description from
  (select conv_id, text, row_number() over (partition by conv_id order by turn) as rn
   from conversations where role = 'user') t
where rn = 1""",
    "arriving": """
select event_id as ticket_key, event_type as Ticket_Subject, props as Ticket_Description,
       case event_type when 'error' then 'Technical' when 'purchase' then 'Billing' when 'signup' then 'Account'
            when 'view' then 'General Inquiry' when 'click' then 'Fraud' end as Issue_Category,
       'Web Form' as Ticket_Channel,
       case event_type when 'error' then 'Critical' when 'purchase' then 'High' when 'signup' then 'Medium'
            when 'view' then 'Low' end as Priority_Level,
       date_trunc('second', cast(ts as timestamp)) as Arrived_At
from events""",
}


def half_even(value: str, digits: int) -> str:
    scale = f"cast({10**digits} as double)"
    return f"round_even(({value}) * {scale}, 0) / {scale}"


def _level(name: str, keys: list[str]) -> str:
    shown = [k if k in keys else f"cast(null as varchar) as {k}" for k in ("Priority_Level", "Issue_Category")]
    known = " and ".join([f"{k} is not null" for k in keys] + ["Resolution_Time_Hours is not null"])
    group = f"group by {', '.join(keys)}" if keys else "having count(*) > 0"
    hours = "Resolution_Time_Hours"
    return f"""select '{name}' as range_level, {', '.join(shown)}, count(*) as n,
  {half_even(f'quantile_cont({hours}, cast(0.25 as double))', 1)} as low_hours,
  {half_even(f'quantile_cont({hours}, cast(0.75 as double))', 1)} as high_hours
from ticket_history where {known} {group}"""


VIEWS["ranges"] = "\nunion all\n".join(
    [_level("pair", ["Priority_Level", "Issue_Category"]), _level("priority", ["Priority_Level"]), _level("all", [])]
)


def short(value: str) -> str:
    return rf"regexp_replace(cast({value} as varchar), '\.0$', '')"


def range_text(low: str, high: str) -> str:
    return f"coalesce({short(low)} || '–' || {short(high)} || ' hours', 'Unavailable')"


def lookup(tickets: str, extra: str = "") -> str:
    """Each ticket of ``tickets`` with its range: pair, priority, all."""
    return f"""select t.*,
  case when pc.n >= 30 then 'pair' when p.n > 0 then 'priority' when g.n > 0 then 'all' end as range_level,
  case when pc.n >= 30 then pc.low_hours when p.n > 0 then p.low_hours else g.low_hours end as low_hours,
  case when pc.n >= 30 then pc.high_hours when p.n > 0 then p.high_hours else g.high_hours end as high_hours
from {tickets} t
left join ranges pc on pc.range_level = 'pair' and pc.Priority_Level = t.Priority_Level
  and pc.Issue_Category = t.Issue_Category
left join ranges p on p.range_level = 'priority' and p.Priority_Level = t.Priority_Level
left join ranges g on g.range_level = 'all'"""


def department(category: str) -> str:
    return f"""case {category} when 'Technical' then 'Technical Support' when 'Billing' then 'Billing'
  when 'Fraud' then 'Fraud & Risk' when 'Account' then 'Account Support' else 'General Support' end"""


def queue_key(department_name: str) -> str:
    return f"""case {department_name} when 'Technical Support' then 'technical' when 'Billing' then 'billing'
  when 'Fraud & Risk' then 'fraud' when 'Account Support' then 'account' else 'general_inquiry' end"""


def ticket_id(key: str) -> str:
    return f"'TKT-' || upper(substr(md5(cast({key} as varchar)), 1, 8))"


def clean_light(text: str) -> str:
    no_tags = f"regexp_replace(lower({text}), '<[^>]+>', '', 'g')"
    no_urls = f"regexp_replace({no_tags}, 'https?://[^{SPACE}]+|www\\.[^{SPACE}]+', '', 'g')"
    return strip(no_urls)


def clean_strict(text: str) -> str:
    no_tags = f"regexp_replace(lower({text}), '<[^>]+>', '', 'g')"
    no_urls = f"regexp_replace({no_tags}, 'https?://[^{SPACE}]+|www\\.[^{SPACE}]+', '', 'g')"
    return strip(f"regexp_replace({no_urls}, '[^a-zA-Z{SPACE}'']', '', 'g')")


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def in_test(key: str) -> str:
    return f"substr(md5(cast({key} as varchar) || '|42'), 1, 8) < '33333333'"


def split_of(key: str) -> str:
    return f"case when {in_test(key)} then 'test' else 'train' end"


def with_views(names: list[str], body: str, **more: str) -> str:
    parts = [f"{n} as ({VIEWS[n]})" for n in names] + [f"{n} as ({sql})" for n, sql in more.items()]
    return f"with {', '.join(parts)}\n{body}"

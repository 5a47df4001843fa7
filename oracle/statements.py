"""One SQL statement per registered query that SQL can express."""

from oracle.terms import vocabulary_views, weight_views
from oracle.views import (
    SPACE,
    WORD,
    clean_light,
    clean_strict,
    department,
    half_even,
    in_test,
    lookup,
    queue_key,
    range_text,
    split_of,
    strip,
    ticket_id,
    with_views,
)

LABELS = ["Critical", "High", "Low", "Medium"]
STAMP = "'%Y-%m-%d %H:%M:%S'"
NULL_TOKENS = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', "
    "'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)
PROBLEM = "error|failed|failure|urgent|critical|blocked|cannot|unable|not working|issue|problem"
URGENCY = (
    "'urgent', 'urgently', 'critical', 'emergency', 'immediately', 'asap', 'blocked', 'failure', 'failed', 'cannot', "
    "'unable', 'outage', 'down', 'security', 'fraud'"
)


def statements() -> dict[str, str]:
    return {**scans(), **projections(), **statistics(), **batch(), **splits(), **term_tables(), **evaluation()}


def scans() -> dict[str, str]:
    csv_columns = ["Ticket_Subject", "Ticket_Description", "Issue_Category", "Ticket_Channel", "Priority_Level"]
    cells = ", ".join(f"case when {c} in ({NULL_TOKENS}) then null else {c} end as {c}" for c in csv_columns)
    scan = f"""select ticket_key, Issue_Category, Ticket_Channel, Priority_Level,
  strftime(Submission_Date, {STAMP}) as Submission_Date, Resolution_Time_Hours from ticket_history"""
    return {
        "scan_tickets": with_views(["ticket_history"], scan),
        "preview": with_views(["ticket_history"], scan + " order by ticket_key limit 10"),
        "batch_defaults": with_views(
            ["ticket_text"],
            """select ticket_key, Ticket_Description, '' as Ticket_Subject, 'General Inquiry' as Issue_Category,
  'Web Form' as Ticket_Channel from ticket_text""",
        ),
        "export_roundtrip": with_views(["ticket_text"], f"select ticket_key, {cells} from ticket_text"),
    }


def projections() -> dict[str, str]:
    def cleaned(view: str, cleaner) -> str:
        return with_views(
            [view],
            f"""select ticket_key, {cleaner('Ticket_Subject')} as Ticket_Subject,
  {cleaner('Ticket_Description')} as Ticket_Description from {view}""",
        )

    def statistics_of(cleaner, extra: str) -> str:
        return with_views(
            ["ticket_text"],
            f"""select ticket_key, cast(length(s) as int) as Subject_Length, cast(length(d) as int) as Description_Length,
  cast(len(regexp_extract_all(s, '[^{SPACE}]+')) as int) as Subject_Word_Count,
  cast(len(regexp_extract_all(d, '[^{SPACE}]+')) as int) as Description_Word_Count,
  cast(length(d) - length(replace(d, '!', '')) as int) as Exclamation_Count,
  cast(length(d) - length(replace(d, '?', '')) as int) as Question_Count, {extra} from texts""",
            texts=f"""select ticket_key, coalesce({cleaner('Ticket_Subject')}, '') as s,
  coalesce({cleaner('Ticket_Description')}, '') as d from ticket_text""",
        )

    def defaults(used_in: str, category: str, channel: str) -> str:
        return f"""select ticket_key, '{used_in}' as used_in, coalesce(Ticket_Subject, '') as Ticket_Subject,
  coalesce(Ticket_Description, '') as Ticket_Description, coalesce(Issue_Category, '{category}') as Issue_Category,
  coalesce(Ticket_Channel, '{channel}') as Ticket_Channel from ticket_text"""

    mail_date = "case when Ticket_Channel = 'Email' then Submission_Date end"
    log_back = "least(120, greatest(0, exp(ln(Resolution_Time_Hours + 1) * 1.1::double) - 1))"
    hour_text = range_text(
        half_even("Resolution_Time_Hours", 1), half_even("Resolution_Time_Hours * cast(1.5 as double)", 1)
    )
    texts = f"select ticket_key, {hour_text} as range_text from ticket_history"
    return {
        "clean_text": cleaned("ticket_text", clean_strict),
        "clean_html": cleaned("ticket_html", clean_strict),
        "clean_text_light": cleaned("ticket_html", clean_light),
        "clean_thread": with_views(
            ["ticket_thread"],
            f"select ticket_key, {clean_strict('Ticket_Description')} as Ticket_Description from ticket_thread",
        ),
        "null_defaults": with_views(
            ["ticket_text"],
            defaults("training", "Unknown", "Unknown")
            + "\nunion all\n"
            + defaults("serving", "General Inquiry", "Web Form"),
        ),
        "model_text": with_views(
            ["ticket_text"],
            """select ticket_key, 'category ' || coalesce(Issue_Category, '') || ' subject '
  || coalesce(Ticket_Subject, '') || ' description ' || coalesce(Ticket_Description, '') as model_text
from ticket_text""",
        ),
        "resolution_text": with_views(
            ["ticket_text"],
            """select ticket_key, coalesce(Ticket_Subject, '') || ' ' || coalesce(Ticket_Description, '')
  as resolution_text from ticket_text""",
        ),
        "text_stats_strict": statistics_of(
            clean_strict, rf"cast(len(regexp_extract_all(d, '\b({PROBLEM})\b')) as int) as Problem_Word_Count"
        ),
        "text_stats_light": statistics_of(
            clean_light,
            f"""cast(len(list_filter(regexp_extract_all(lower(d), '{WORD}+'), lambda x: x in ({URGENCY}))) as int)
  as Urgency_Word_Count""",
        ),
        "date_features_zero": with_views(
            ["ticket_history"],
            """select ticket_key, cast(coalesce(year(ts), 0) as int) as Submission_Year, cast(coalesce(month(ts), 0) as int) as Submission_Month,
  cast(coalesce(day(ts), 0) as int) as Submission_Day, cast(coalesce(isodow(ts) - 1, 0) as int) as Submission_DayOfWeek,
  cast(coalesce(hour(ts), 0) as int) as Submission_Hour from dated""",
            dated=f"select ticket_key, {mail_date} as ts from ticket_history",
        ),
        "date_features_default": with_views(
            ["ticket_history"],
            """select ticket_key, cast(coalesce(hour(ts), 12) as int) as submission_hour,
  cast(coalesce(isodow(ts) - 1, 0) as int) as submission_dayofweek, cast(coalesce(month(ts), 1) as int) as submission_month from dated""",
            dated=f"select ticket_key, {mail_date} as ts from ticket_history",
        ),
        "clip_log_roundtrip": with_views(
            ["ticket_history"],
            f"""select ticket_key, {half_even('ln(Resolution_Time_Hours + 1)', 6)} as log_hours,
  case when Resolution_Time_Hours is not null then {half_even(log_back, 6)} end as hours_0_120,
  case when Resolution_Time_Hours is not null then {half_even(f'greatest(1, {log_back})', 6)} end as hours_1_120
from ticket_history""",
        ),
        "route_department": with_views(
            ["ticket_text"],
            f"""select ticket_key, Issue_Category, department, {queue_key('department')} as queue_key
from (select ticket_key, Issue_Category, {department('Issue_Category')} as department from ticket_text)""",
        ),
        "range_text": with_views(["ticket_history"], texts),
        "range_parse": with_views(
            ["ticket_history"],
            """select ticket_key,
  try_cast(split_part(replace(range_text, ' hours', ''), '–', 1) as double) as low_hours,
  try_cast(split_part(replace(range_text, ' hours', ''), '–', 2) as double) as high_hours from texts""",
            texts=texts,
        ),
        "ticket_id": with_views(
            ["ticket_text"], f"select ticket_key, {ticket_id('ticket_key')} as Ticket_ID from ticket_text"
        ),
        "blank_rejects": with_views(
            ["ticket_text"],
            f"""select ticket_key, Ticket_Subject, case when coalesce({strip('Ticket_Subject')}, '') = ''
  then 'rejected' else 'accepted' end as outcome from ticket_text""",
        ),
        "dropna_subset": with_views(
            ["ticket_history"],
            """select ticket_key, Priority_Level, Issue_Category, Ticket_Channel, Resolution_Time_Hours
from ticket_history where Priority_Level is not null and Issue_Category is not null and Ticket_Channel is not null
  and Resolution_Time_Hours is not null""",
        ),
    }


def statistics() -> dict[str, str]:
    hours = "Resolution_Time_Hours"

    def by(key: str) -> str:
        return with_views(
            ["ticket_history"],
            f"""select {key}, count({hours}) as count, {half_even(f'avg({hours})', 2)} as mean,
  {half_even(f'quantile_cont({hours}, cast(0.5 as double))', 2)} as median,
  {half_even(f'stddev_samp({hours})', 2)} as std from ticket_history where {key} is not null group by {key}""",
        )

    quartiles = ", ".join(
        f"{half_even(f'quantile_cont({hours}, cast({q / 100} as double))', 6)} as q{q}" for q in (25, 50, 75)
    )
    found = lookup("ticket_history")
    return {
        "resolution_ranges": with_views(["ticket_history", "ranges"], "select * from ranges"),
        "ranges_appended": with_views(["ticket_history", "ranges"], "select * from ranges"),
        "resolution_lookup": with_views(
            ["ticket_history", "ranges"],
            f"""select ticket_key, Priority_Level, Issue_Category, range_level, low_hours, high_hours,
  {range_text('low_hours', 'high_hours')} as expected_resolution_range,
  {department('Issue_Category')} as department from found""",
            found=found,
        ),
        "resolution_describe": with_views(
            ["ticket_history"],
            f"""select count({hours}) as count, {half_even(f'avg({hours})', 6)} as mean,
  {half_even(f'stddev_samp({hours})', 6)} as std, min({hours}) as min, {quartiles}, max({hours}) as max
from ticket_history""",
        ),
        "stats_by_priority": by("Priority_Level"),
        "stats_by_category": by("Issue_Category"),
        "stats_by_channel": by("Ticket_Channel"),
        "regression_metrics": with_views(
            ["ticket_history", "ranges"],
            f"""select count(*) as rows, {half_even('avg(abs(y - p))', 6)} as mae,
  {half_even('sqrt(avg((y - p) * (y - p)))', 6)} as rmse,
  {half_even('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 6)} as r2 from judged where y is not null""",
            found=found,
            judged=f"select {hours} as y, least(120, greatest(0, (low_hours + high_hours) / 2)) as p from found",
        ),
    }


def batch() -> dict[str, str]:
    triaged = f"""select ticket_key, Ticket_Subject, Ticket_Description, Issue_Category, Ticket_Channel, Priority_Level,
  Priority_Level as predicted_priority, {department('Issue_Category')} as routed_department,
  {range_text('low_hours', 'high_hours')} as expected_resolution_range, {ticket_id('ticket_key')} as Ticket_ID
from ({lookup('ticket_text')})"""
    text_views = ["ticket_history", "ranges", "ticket_text"]
    queued = f"""select Ticket_ID, Ticket_Subject, Ticket_Description, Issue_Category, predicted_priority as Priority,
  expected_resolution_range as Expected_Resolution, Ticket_Channel, routed_department as Routed_Department,
  case when Ticket_Channel = 'Email' then '2026-01-01 08:00:00' else '2026-01-01 12:00:00' end as Routed_At,
  {queue_key('routed_department')} as department_key, md5(cast(ticket_key as varchar)) as ticket_md5 from triaged"""
    numbered = """select *, row_number() over (partition by department_key order by Routed_At, Ticket_ID, ticket_md5)
  as Queue_No from queued"""
    reported = f"""select Priority_Level as predicted_priority, {department('Issue_Category')} as routed_department
from ticket_history"""

    def distribution(key: str) -> str:
        return with_views(
            ["ticket_history"],
            f"select {key}, count(*) as tickets from reported where {key} is not null group by {key}",
            reported=reported,
        )

    departments = """select * from (values ('Technical Support', 'technical'), ('Billing', 'billing'),
  ('Fraud & Risk', 'fraud'), ('Account Support', 'account'), ('General Support', 'general_inquiry'))
  as t(department, queue_key)"""
    errors = """select * replace (case when Issue_Category = 'Technical' then Issue_Category end as Issue_Category)
from arriving"""
    error_queue = f"""select {ticket_id('ticket_key')} as Ticket_ID, Priority_Level as Priority,
  {range_text('low_hours', 'high_hours')} as Expected_Resolution, strftime(Arrived_At, {STAMP}) as Routed_At,
  {queue_key(department('Issue_Category'))} as queue_key from ({lookup('errors')})"""
    event_views = ["ticket_history", "ranges", "arriving"]
    routed = with_views(text_views, "select * exclude (ticket_md5) from queued", triaged=triaged, queued=queued)
    return {
        "triage_batch": with_views(text_views, triaged),
        "batch_results_view": with_views(
            text_views,
            """select Ticket_ID, Ticket_Subject, Issue_Category, predicted_priority, expected_resolution_range,
  routed_department, Ticket_Channel from triaged""",
            triaged=triaged,
        ),
        "route_append": routed,
        "route_retried": routed,
        "queue_numbers": with_views(
            text_views,
            "select Routed_Department, Queue_No, Ticket_ID from numbered",
            triaged=triaged,
            queued=queued,
            numbered=numbered,
        ),
        "queue_view": with_views(
            text_views,
            """select Routed_Department, Queue_No, Ticket_ID, Ticket_Subject, Issue_Category, Priority,
  Expected_Resolution, Ticket_Channel, Routed_At from numbered""",
            triaged=triaged,
            queued=queued,
            numbered=numbered,
        ),
        "queue_scan": with_views(
            event_views,
            """select department, d.queue_key, Ticket_ID, Priority, Expected_Resolution, Routed_At
from departments d left join queued q on d.queue_key = q.queue_key""",
            departments=departments,
            errors=errors,
            queued=error_queue,
        ),
        "queue_depth": with_views(
            event_views,
            """select department, d.queue_key, count(Ticket_ID) as waiting
from departments d left join queued q on d.queue_key = q.queue_key group by all""",
            departments=departments,
            errors=errors,
            queued=error_queue,
        ),
        "priority_distribution": distribution("predicted_priority"),
        "department_distribution": distribution("routed_department"),
        "batch_kpis": with_views(
            ["ticket_history"],
            """select count(*) as total_tickets, count(distinct routed_department) as departments,
  count(*) filter (predicted_priority = 'Critical') as critical_tickets,
  count(*) filter (predicted_priority = 'High') as high_priority_tickets from reported""",
            reported=reported,
        ),
        "priority_by_department": with_views(
            ["ticket_history"],
            "select routed_department, "
            + ", ".join(f"count(*) filter (predicted_priority = '{p}') as {p}" for p in LABELS)
            + " from reported group by routed_department",
            reported=reported,
        ),
        "stream_routing": with_views(
            event_views,
            f"""select {ticket_id('ticket_key')} as Ticket_ID, Ticket_Subject, Ticket_Description, Issue_Category,
  Priority_Level as Priority, {range_text('low_hours', 'high_hours')} as Expected_Resolution, Ticket_Channel,
  {department('Issue_Category')} as Routed_Department, strftime(Arrived_At, {STAMP}) as Routed_At,
  {queue_key(department('Issue_Category'))} as department_key from ({lookup('arriving')})""",
        ),
        "stream_queue_depth": with_views(
            ["arriving"],
            f"select {department('Issue_Category')} as department, count(*) as waiting from arriving group by 1",
        ),
    }


def splits() -> dict[str, str]:
    stratified = """select ticket_key, Priority_Level, case when row_number() over (partition by Priority_Level
  order by md5(cast(ticket_key as varchar) || '|42')) <= ceil(count(*) over (partition by Priority_Level)
  * cast(0.2 as double)) then 'test' else 'train' end as split from ticket_history"""
    text_split = f"select ticket_key, Priority_Level, Ticket_Subject, Issue_Category, {split_of('ticket_key')} as split from ticket_text"
    mapping = """select Priority_Level as label, cast(row_number() over (order by Priority_Level) - 1 as integer) as code
from (select distinct Priority_Level from split where split = 'train' and Priority_Level is not null)"""
    columns = ["submission_hour", "submission_dayofweek", "submission_month"]
    scaled = ", ".join(
        half_even(f"{c} / (select coalesce(nullif(stddev_pop({c}), 0), 1) from parts where split = 'train')", 6)
        + f" as {c}"
        for c in columns
    )
    return {
        "stratified_split": with_views(["ticket_history"], stratified),
        "random_split": with_views(
            ["ticket_history"], f"select ticket_key, {split_of('ticket_key')} as split from ticket_history"
        ),
        "split_sizes": with_views(
            ["ticket_history"],
            f"""select split, count(*) as rows, 'stratified' as kind from stratified group by split
union all select {split_of('ticket_key')}, count(*), 'random' from ticket_history group by 1""",
            stratified=stratified,
        ),
        "label_mapping": with_views(["ticket_text"], mapping, split=text_split),
        "label_encode": with_views(
            ["ticket_text"],
            """select ticket_key, Priority_Level, split, code as label_code
from split left join mapping on Priority_Level = label""",
            split=text_split,
            mapping=mapping,
        ),
        "label_decode": with_views(
            ["ticket_text"],
            """select ticket_key, coalesce(code, 99) as label_code, coalesce(label, '99') as label
from split left join mapping on Priority_Level = label""",
            split=text_split,
            mapping=mapping,
        ),
        "std_scale": with_views(
            ["ticket_history"],
            f"select ticket_key, {scaled} from parts",
            parts=f"""select ticket_key, {split_of('ticket_key')} as split, hour(Submission_Date) as submission_hour,
  isodow(Submission_Date) - 1 as submission_dayofweek, month(Submission_Date) as submission_month
from ticket_history""",
        ),
        "target_encode": target_encode(text_split),
        "ordered_target_encode": ordered_target_encode(text_split),
        "one_hot": with_views(
            ["ticket_text"],
            """select ticket_key, 'Issue_Category' as feature, category as value, c.position
from filled join categories c on category = c.value
union all
select ticket_key, 'Ticket_Channel', channel, h.position from filled join channels h on channel = h.value""",
            split=f"select ticket_key, Issue_Category, Ticket_Channel, {split_of('ticket_key')} as split from ticket_text",
            categories="""select value, cast(row_number() over (order by value) - 1 as integer) as position from
  (select distinct coalesce(Issue_Category, 'Unknown') as value from split where split = 'train')""",
            channels="""select value, cast(row_number() over (order by value) - 1 as integer) as position from
  (select distinct coalesce(Ticket_Channel, 'Unknown') as value from split where split = 'train')""",
            filled="""select ticket_key, coalesce(Issue_Category, 'General Inquiry') as category,
  coalesce(Ticket_Channel, 'Web Form') as channel from split""",
        ),
    }


def target_encode(text_split: str) -> str:
    def encoded(value: str, label: str, name: str) -> str:
        """Mean of the target over training rows of the category, other folds only for training rows."""
        flag = f"cast(coalesce(Priority_Level = '{label}', false) as double)"
        prior = f"(select avg({flag}) from rows where split = 'train')"
        hit = f"sum(case when split = 'train' then {flag} else 0 end)"
        seen = "sum(case when split = 'train' then 1.0::double else 0 end)"
        total, own = f"over (partition by {value})", f"over (partition by {value}, fold)"

        def used(measure: str) -> str:
            return f"({measure} {total} - case when split = 'train' then {measure} {own} else 0 end)"

        return half_even(f"({used(hit)} + {prior}) / ({used(seen)} + 1)", 6) + f" as {name}"

    lines = [encoded("subject", "Low", "subject_low")]
    lines += [encoded("category", p, f"category_{p.lower()}") for p in LABELS]
    return with_views(
        ["ticket_text"],
        f"select ticket_key, {', '.join(lines)} from rows",
        split=text_split,
        rows=f"""select ticket_key, Priority_Level, split, coalesce(Issue_Category, '') as category,
  {clean_light("coalesce(Ticket_Subject, '')")} as subject, case when split = 'train' then
  cast('0x' || substr(md5(cast(ticket_key as varchar)), 1, 6) as bigint) % 5 else -1 end as fold from split""",
    )


def ordered_target_encode(text_split: str) -> str:
    def encoded(value: str, label: str, name: str) -> str:
        """Mean of the target over the category's training rows before the row, or over all of them for other rows."""
        flag = f"cast(coalesce(Priority_Level = '{label}', false) as double)"
        prior = f"(select avg({flag}) from rows where split = 'train')"
        before = f"over (partition by split, {value} order by place rows between unbounded preceding and 1 preceding)"
        total = f"filter (where split = 'train') over (partition by {value})"

        def used(measure: str) -> str:
            return f"coalesce(case when split = 'train' then sum({measure}) {before} else sum({measure}) {total} end, 0)"

        return half_even(f"({used(flag)} + {prior}) / ({used('1.0::double')} + 1)", 6) + f" as {name}"

    lines = [encoded("subject", "Low", "subject_low")]
    lines += [encoded("category", p, f"category_{p.lower()}") for p in LABELS]
    return with_views(
        ["ticket_text"],
        f"select ticket_key, {', '.join(lines)} from rows",
        split=text_split,
        rows=f"""select ticket_key, Priority_Level, split, coalesce(Issue_Category, '') as category,
  {clean_light("coalesce(Ticket_Subject, '')")} as subject, md5(cast(ticket_key as varchar)) as place from split""",
    )


def term_tables() -> dict[str, str]:
    cleaned = f"""select ticket_key, {split_of('ticket_key')} as split,
  {clean_strict("coalesce(Ticket_Subject, '')")} as subject,
  {clean_strict("coalesce(Ticket_Description, '')")} as description from ticket_text"""
    combined = f"""select ticket_key, {split_of('ticket_key')} as split,
  coalesce(Ticket_Subject, '') || ' ' || coalesce(Ticket_Description, '') as text from ticket_text"""

    def weights(source: str, text: str, terms: int, documents: int, sublinear: bool, stop: bool) -> str:
        return with_views(
            ["ticket_text"],
            "select * from weights",
            texts=source,
            **vocabulary_views("texts", text, terms, documents, stop),
            **weight_views("texts", ["ticket_key"], sublinear),
        )

    labelled = f"""select ticket_key, Priority_Level, {clean_strict('''
  'category ' || coalesce(Issue_Category, '') || ' subject ' || coalesce(Ticket_Subject, '') || ' description '
  || coalesce(Ticket_Description, '')''')} as text,
  case when row_number() over (partition by Priority_Level order by md5(cast(ticket_key as varchar) || '|42'))
  <= ceil(count(*) over (partition by Priority_Level) * cast(0.2 as double)) then 'test' else 'train' end as split
from ticket_text where Priority_Level is not null"""
    return {
        "vocab_topk": with_views(
            ["ticket_text"],
            "select * from vocabulary",
            texts=cleaned,
            **vocabulary_views("texts", "subject", 2500, 2, False),
        ),
        "tfidf_long": weights(cleaned, "description", 7500, 2, True, False),
        "tfidf_plain_counts": weights(cleaned, "description", 5000, 1, False, True),
        "tfidf_resolution": weights(combined, "text", 5000, 1, True, False),
        "preprocess_job": with_views(
            ["ticket_text"],
            "select * from weights",
            labelled=labelled,
            mapping="""select Priority_Level as label, cast(row_number() over (order by Priority_Level) - 1 as integer)
  as label_code from (select distinct Priority_Level from labelled where split = 'train')""",
            texts="select * from labelled left join mapping on Priority_Level = label",
            **vocabulary_views("texts", "text", 5000, 2, True),
            **weight_views("texts", ["ticket_key", "split", "label_code"], True),
        ),
    }


def evaluation() -> dict[str, str]:
    judged = """select Priority_Level as actual, case when Resolution_Time_Hours < 10 then 'Critical'
  when Resolution_Time_Hours < 40 then 'High' when Resolution_Time_Hours < 80 then 'Medium' else 'Low' end as predicted
from ticket_history where Priority_Level is not null"""
    frame = "select unnest(['Critical', 'High', 'Low', 'Medium']) as label"
    scored = """select label, coalesce(hits / nullif(found, 0), 0) as precision,
  coalesce(hits / nullif(support, 0), 0) as recall, support, hits from (
  select label, (select count(*) from judged where actual = label) as support,
    (select count(*) from judged where predicted = label) as found,
    cast((select count(*) from judged where actual = label and predicted = label) as double) as hits from frame)"""
    with_f1 = """select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from scored"""

    def line(label: str, values: list[str], support: str, group: str = "") -> str:
        shown = [f"{half_even(v, 6)} as {n}" for v, n in zip(values, ["precision", "recall", "f1"], strict=True)]
        return f"select {label} as label, {', '.join(shown)}, cast({support} as bigint) as support from with_f1 {group}"

    scores = ["precision", "recall", "f1"]
    lines = [
        line("label", scores, "support"),
        line("'accuracy'", ["sum(hits) / sum(support)"] * 3, "sum(support)"),
        line("'macro avg'", [f"avg({s})" for s in scores], "sum(support)"),
        line("'weighted avg'", [f"sum({s} * support) / sum(support)" for s in scores], "sum(support)"),
    ]
    return {
        "confusion_matrix": with_views(
            ["ticket_history"],
            "select label as actual, "
            + ", ".join(f"(select count(*) from judged where actual = label and predicted = '{p}') as {p}" for p in LABELS)
            + " from frame",
            judged=judged,
            frame=frame,
        ),
        "classification_report": with_views(
            ["ticket_history"],
            "\nunion all\n".join(lines),
            judged=judged,
            frame=frame,
            scored=scored,
            with_f1=with_f1,
        ),
        "accuracy": with_views(
            ["ticket_history"],
            f"select {half_even('avg(cast(actual = predicted as double))', 4)} as accuracy from judged",
            judged=judged,
        ),
        "early_stop": with_views(
            [],
            """select * from (
select iteration as stop_iteration, best_iteration, best_loss, stopped_early from (
  select iteration, best_loss, best_iteration, iteration - best_iteration >= 5 as stopped_early from (
    select iteration, min(loss) over w as best_loss, arg_min(iteration, loss) over w as best_iteration from curve
    window w as (order by iteration rows between unbounded preceding and current row)))
order by stopped_early desc, case when stopped_early then iteration else -iteration end limit 1)""",
            curve=f"""select cast(datediff('day', date '2024-01-01', cast(ts as date)) as integer) as iteration,
  {half_even('avg(value)', 6)} as loss from events group by 1""",
        ),
    }

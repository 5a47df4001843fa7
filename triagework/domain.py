"""Fixed values of the ticket domain and the schemas of its tables."""

from pyspark.sql import types as T

# Labels and categories a ticket may carry.
PRIORITIES = ["Critical", "High", "Low", "Medium"]
CATEGORIES = ["Account", "Billing", "Fraud", "General Inquiry", "Technical"]
CHANNELS = ["Chat", "Email", "Web Form"]

# Category -> department; everything else goes to DEFAULT_DEPARTMENT.
DEPARTMENT_OF = {
    "Technical": "Technical Support",
    "Billing": "Billing",
    "Fraud": "Fraud & Risk",
    "Account": "Account Support",
    "General Inquiry": "General Support",
}
DEFAULT_DEPARTMENT = "General Support"

# Department -> queue partition; everything else goes to DEFAULT_QUEUE.
QUEUE_OF = {
    "Technical Support": "technical",
    "Billing": "billing",
    "Fraud & Risk": "fraud",
    "Account Support": "account",
    "General Support": "general_inquiry",
}
DEFAULT_QUEUE = "general_inquiry"

# Defaults for missing text and categories.
TRAINING_DEFAULTS = {
    "Ticket_Subject": "",
    "Ticket_Description": "",
    "Issue_Category": "Unknown",
    "Ticket_Channel": "Unknown",
}
SERVING_DEFAULTS = {
    "Ticket_Subject": "",
    "Ticket_Description": "",
    "Issue_Category": "General Inquiry",
    "Ticket_Channel": "Web Form",
}

# Words counted as signs of a problem, and of urgency.
PROBLEM_WORDS = [
    "error", "failed", "failure", "urgent", "critical", "blocked", "cannot", "unable", "not working", "issue",
    "problem",
]
URGENCY_WORDS = [
    "urgent", "urgently", "critical", "emergency", "immediately", "asap", "blocked", "failure", "failed", "cannot",
    "unable", "outage", "down", "security", "fraud",
]

# CSV cells that mean "no value".
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Pairs below this many known hours fall back to the priority's range.
MIN_PAIR_COUNT = 30
NO_RANGE = "Unavailable"

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("Ticket_Subject", T.StringType()),
        T.StructField("Ticket_Description", T.StringType()),
        T.StructField("Issue_Category", T.StringType()),
        T.StructField("Ticket_Channel", T.StringType()),
        T.StructField("Priority_Level", T.StringType()),
        T.StructField("Submission_Date", T.TimestampType()),
        T.StructField("Resolution_Time_Hours", T.DoubleType()),
    ]
)

QUEUE_COLUMNS = [
    "Ticket_ID", "Ticket_Subject", "Ticket_Description", "Issue_Category", "Priority", "Expected_Resolution",
    "Ticket_Channel", "Routed_Department", "Routed_At",
]

# Columns shown in the batch result and the queue views, in this order.
BATCH_VIEW_COLUMNS = [
    "Ticket_ID", "Ticket_Subject", "Issue_Category", "predicted_priority", "expected_resolution_range",
    "routed_department", "Ticket_Channel",
]

# The public English stop-word list of scikit-learn.
ENGLISH_STOP_WORDS = tuple(
    """
a about above across after afterwards again against all almost alone along already also although always am among
amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became
because become becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom
but by call can cannot cant co con could couldnt cry de describe detail do done down due during each eg eight either
eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find
fire first five for former formerly forty found four from front full further get give go had has hasnt have he hence her
here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc indeed interest
into is it its itself keep last latter latterly least less ltd made many may me meanwhile might mill mine more moreover
most mostly move much must my myself name namely neither never nevertheless next nine no nobody none noone nor not
nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per
perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six
sixty so some somehow someone something sometime sometimes somewhere still such system take ten than that the their them
themselves then thence there thereafter thereby therefore therein thereupon these they thick thin third this those though
three through throughout thru thus to together too top toward towards twelve twenty two un under until up upon us very
via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever
whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself
yourselves
""".split()
)

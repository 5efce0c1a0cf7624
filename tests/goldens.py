"""Golden rows for the fixtures, derived by hand from the rules."""

MAIL_GOLDEN: list[tuple] = [
    (1, None, "Rana Odeh", "Project Team", "URGENT: permit form", "High", "Please review the form and confirm by tomorrow.|The board agreed on the layout.|Nothing else is open here.", "Please review the form and confirm by tomorrow.", "Please review the form and confirm by tomorrow.", "The board agreed on the layout."),
    (2, None, "To: Sami", "Sami", "Requires confirmation", "Normal", "Send the file by end of day please!|Is the status known now?|Hello there all of you.|We met at 3/4 in town.", "Send the file by end of day please!", "We met at 3/4 in town.|Send the file by end of day please!", "No clear decision detected."),
    (3, "EMPTY_EMAIL", None, None, None, None, None, None, None, None),
    (4, None, "Requires confirmation", "Requires confirmation", "notes", "Medium", "A short one.|The deadline moves to next week for all teams.", "No clear action item detected.", "The deadline moves to next week for all teams.", "No clear decision detected."),
    (5, None, "Requires confirmation", "all", "Requires confirmation", "Normal", "Requires confirmation", "No clear action item detected.", "No clear deadline detected.", "No clear decision detected."),
]
QA_GOLDEN: list[tuple] = [
    (1, None, "Supported by supplied information", "High", 66, 1, "permit|renewal"), (2, None, "Not found in supplied information", "Low", None, 0, None), (3, None, "Supported by supplied information", "High", 100, 2, "hours|office|opening"),
    (4, "EMPTY_REFERENCE", None, None, None, None, None), (5, "EMPTY_QUESTION", None, None, None, None, None), (6, "NO_PASSAGES", None, None, None, None, None), (7, "NO_TERMS", None, None, None, None, None),
]
QA_REPORT_GOLDEN: list[tuple] = []
PAIR_GOLDEN: list[tuple] = [(1, None, "matched|conflict|missing", 67, 1), (2, "EMPTY_B", None, None, None), (3, "EMPTY_A", None, None, None), (4, "NO_ITEMS", None, None, None), (5, None, "matched", 100, 0)]
CHART_GOLDEN: list[tuple] = [
    (1, None, 3, "Cases by Unit", "North=1200|South=85|East=1000"), (2, "PIE_NEGATIVE", None, None, None), (3, "PIE_TOTAL", None, None, None), (4, "NOT_NUMERIC", None, None, None), (5, "BAD_CHART_TYPE", None, None, None), (6, "EMPTY_CHART", None, None, None),
    (7, "NO_ROWS", None, None, None), (8, "BLANK_HEADER", None, None, None), (9, "ROW_WIDTH", None, None, None), (10, "TOO_FEW_COLUMNS", None, None, None), (11, None, 2, "Plan", "Plan=5|Build=10"), (12, "BAD_DATE", None, None, None), (13, "NO_TASK_NAME", None, None, None),
    (14, "END_BEFORE_START", None, None, None), (15, "TOO_FEW_COLUMNS", None, None, None), (16, "BAD_DATE", None, None, None),
]
QA_REPORT_GOLDEN += [
    (1, "Reference source: Manually entered text\nQuestion: Which documents are required for permit renewal?\nStatus: Supported by supplied information\nConfidence indicator: High\n\nANSWER\nBased on the supplied information: Permit renewal requires a valid identity card and proof of payment.\n\nSUPPORTING INFORMATION\n- Permit renewal requires a valid identity card and proof of payment. (score: 66%)"),
    (2, "Reference source: Manually entered text\nQuestion: Can my dog apply online?\nStatus: Not found in supplied information\nConfidence indicator: Low\n\nANSWER\nThe supplied information does not contain a sufficiently clear answer to this question.\n\nSUPPORTING INFORMATION\n- No sufficiently relevant passage identified."),
    (3, "Reference source: Manually entered text\nQuestion: What are the opening hours of the office?\nStatus: Supported by supplied information\nConfidence indicator: High\n\nANSWER\nBased on the supplied information: Opening hours of the office are nine to three.\n\nSUPPORTING INFORMATION\n- Opening hours of the office are nine to three. (score: 100%)"),
]

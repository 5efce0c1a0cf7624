"""Sentences for the default lexicons, which the driver's invented prose does not contain, to plant in its documents; lexicons
of what it does contain; small inputs for tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DOCUMENTS = [
    (1, "BRD", "Service Purpose: digitize the parking permit service for residents. Applicants submit an identification number and proof of payment. An employee should review requests quickly. If valid, the permit is approved."),
    (2, "SRS", "The system shall notify the applicant. Errors must be logged. The interface will be user-friendly. Testing covers each test case."),
    (3, " brd ", "Stakeholders: citizens and vendors. Functional requirements: the portal must allow uploads. Security and availability are adequate. Must work."),
    (4, "BRD", "   "),
    (5, "RFP", "Any text will do here."),
    (6, "srs", "No keyword in this one at all, nothing to see!"),
    (7, "BRD", "Automate a trade licence renewal service. When complete, return the form to the department. Only approved requests receive a licence."),
]
MAILS = [
    (1, "From: Rana Odeh\nTo: Project Team\nSubject: URGENT: permit form\nDate: today\n\nPlease review the form and confirm by tomorrow. The board agreed on the layout. Nothing else is open here.\nRegards,\nRana please ignore"),
    (2, "From:\nTo: Sami\nHello there all of you. We met at 3/4 in town. Send the file by end of day please! Is the status known now?"),
    (3, "  \n \t "),
    (4, "Subject: notes\nA short one. The deadline moves to next week for all teams. the deadline moves to NEXT week for all teams."),
    (5, "To: all\nThanks\nThis line is never read at all."),
]
QUESTIONS = [
    (1, "Permit renewal requires a valid identity card and proof of payment. The fee is 15 JOD. Processing takes two working days.", "Which documents are required for permit renewal?"),
    (2, "Permit renewal requires a valid identity card and proof of payment. The fee is 15 JOD. Processing takes two working days.", "Can my dog apply online?"),
    (3, "Opening hours of the office are nine to three.\n\n- Apply at the branch office or online portal.", "What are the opening hours of the office?"),
    (4, " ", "What is the fee?"), (5, "Some text of three words.", " "), (6, "a b. c d.", "What fee applies?"), (7, "The fee is 15 JOD for all.", "is it of the?"),
]
PAIRS = [
    (1, "Applicants must provide a residence card. Approved permits arrive within 5 days. The portal must notify rejected applicants.", "The applicant shall provide a residence card. Approved permits arrive within 7 days. The portal shall archive every closed file."),
    (2, "One two three.", "   "), (3, " ", "One two three."), (4, "One.", "Two."), (5, "Same item in both texts.\nSame item in both texts.", "same item in both texts."),
]
CHARTS = [
    (1, "Bar Chart", "Unit,Cases\nNorth,\"1,200\"\nSouth,85\n\nEast,1_000", ""), (2, "Pie Chart", "Unit,Cases\nNorth,-1\nSouth,85", ""), (3, "Pie Chart", "Unit,Cases\nNorth,0", ""), (4, "Line Chart", "Unit,Cases\nNorth,1d", ""),
    (5, "Radar", "Unit,Cases\nNorth,1", ""), (6, "Bar Chart", " ", ""), (7, "Bar Chart", "Unit,Cases", ""), (8, "Bar Chart", "Unit,\nNorth,1", ""), (9, "Bar Chart", "Unit,Cases\nNorth,1,2", ""), (10, "Bar Chart", "Unit\nNorth", ""),
    (11, "Gantt Chart", "Task,Start,End\nBuild,2026-8-6,2026-08-15\nPlan,2026-08-01,2026-08-05", "Plan"), (12, "Gantt Chart", "Task,Start,End\nBuild,2026-02-30,2026-03-01", ""), (13, "Gantt Chart", "Task,Start,End\n,2026-02-03,2026-03-01", ""),
    (14, "Gantt Chart", "Task,Start,End\nBuild,2026-02-03,2026-02-01", ""), (15, "Gantt Chart", "Task,Start\nBuild,2026-02-03", ""), (16, "Gantt Chart", "Task,Start,End\nBuild,2026-02-03,2026/02/04", ""),
]
FILES = [("a/one.txt", "plain text é".encode()), ("a/two.TXT", b"caf\xe9"), ("b/none.txt", b" \n"), ("b/x.csv", b"a,b"), ("b/bad.docx", b"no zip")]

#: Characters of a document that follow a planted question.
OPENING = 100

#: Fragments that occur in the driver's documents.
DATA_SECTIONS = {"Endings": ["tion ", "ment ", "keit", "ble "], "Articles": [" the ", " le ", " der ", " el "], "Junk": ["###", "|", "$$$"], "Licences": ["licensed under", "copyright"], "Contact": ["@", "http", "phone"], "Absent": ["zzqx"]}
DATA_SRS_SECTIONS = {"Openings": ["the ", "der ", "les "], "Closings": ["tion.", "ment.", "heit."], "Marks": ["?", "!"], "Absent": ["zzqx"]}
DATA_REQUIRED = {"|": "Table", "password": "Credential", "token": "Credential token", "@": "Address"}
DATA_RECIPIENTS = {"copyright": "Owner", "ment": "Ending", " le ": "French", "@": "Address"}
DATA_HINTS = {"articles": ["hein", "der", "des"], "endings": ["onnd", "onhe", "tion"], "pieces": ["para", "ci"]}
DATA_LABELS = {"licensed": "Licence", " the ": "English", " der ": "German", "tion": "Ending", "###": "Junk", "zzqx": "None"}
DATA_WORDS = ["erin", "the ", "tion", "euxeux"]
DATA_PHRASES = ["and the", "of the", "###", "de la", "zzqx"]
DATA_TERMS = ["thin", "enth", "aux "]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def dealt(key: Column, values: list[str]) -> Column:
    """One of the values by the remainder of a key."""
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, text): all documents behind one of the texts of DOCUMENTS each; a blank one stands alone."""
    kind, lead = (dealt(F.col("doc_id"), [d[i] for d in DOCUMENTS]) for i in (1, 2))
    return docs.select("doc_id", kind.alias("kind"), F.when(F.trim(lead) == "", lead).otherwise(F.concat(lead, F.lit(" "), "text")).alias("text"))


def literal(value: object) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], *names: str) -> str:
    """Rows as a SQL table expression."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({', '.join(names)})"

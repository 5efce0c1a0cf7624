"""Repair of conversations: the cheapest edits after which the roles read as a system turn, if any, and pairs of user and
assistant.

A turn may be kept (0), given the role of user or assistant (1) or deleted (2); an empty turn of either may be inserted
anywhere (5). Blank turns and turns whose role and text were there before must go; one cut short, which ends without a
full stop, question or exclamation mark, costs 5 more if it stays. Of equally cheap repairs the one whose edits, as the
letters K, R, D and I, come first counts.

Conversations are dealt by a hash of their id and read in batches of whole conversations. A batch is one recursive query
of DuckDB: a recursion advances all its conversations by one turn, and keeps for each state of the grammar the least cost
and the edits that lead there. Edits of equal cost that lead to one state can be compared before the rest is known, as
neither begins with the other: each ends in an edit of the same turn.

Null roles and texts count as one space, so that such a text is blank; turns without a number come first, equal numbers
in the order of role and text. Rows without a conv_id are one conversation, of a null id. Repeated rows are duplicates of
their first. Empty tables give no rows. A conversation is held whole by one task, as a document is; one of more than
``BATCH_ROWS`` turns has a query of its own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.common import bound_batches, lean, partitions

#: Rows and bytes of text of a batch, unless one conversation has more.
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20
#: Costs of the edits, and of a turn cut short that stays.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5

OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"


def _moves() -> str:
    """Rows (before, edit, initial, after, letters, cost): an insertion or none, then an edit of a turn; the states are 0 at
    the start, 1 after a system turn, 2 after a user's and 3 after an assistant's."""
    role = {0: "u", 1: "u", 2: "a", 3: "u"}
    after = {"s": 1, "u": 2, "a": 3}
    rows = []
    for state in role:
        for first in ("", "I"):
            at, cost = (after[role[state]], INSERT) if first else (state, 0)
            rows.append((state, "D", "", at, first + "D", cost + DELETE))
            rows.append((state, "R", "", after[role[at]], first + "R", cost + REROLE))
            rows += [(state, "K", x, after[x], first + "K", cost + KEEP) for x in (role[at], *("s" * (at == 0)))]
    return ", ".join(f"({s}, '{e}', '{i}', {a}, '{n}', {c}::BIGINT)" for s, e, i, a, n, c in rows)


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The turns of a batch in order, with their first fault and initial.
TURNS = f"""
CREATE OR REPLACE TEMP TABLE turns AS
WITH stood AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS step FROM (SELECT c, turn, role, text, rtrim(text, {_BLANKS}) AS body, unnest(range(copies)) FROM given))
SELECT c, turn, role, text, left(role, 1) AS initial, step,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY step) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM stood
"""
REPAIR = f"""
WITH RECURSIVE moves(before, edit, initial, after, letters, cost) AS (VALUES {_moves()}),
best(c, state, step, v) USING KEY (c, state) AS (
    SELECT c, 0, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': ''}} FROM (SELECT DISTINCT c FROM given)
    UNION
    SELECT b.c, m.after, b.step + 1, min({{'cost': b.v.cost + m.cost + CASE WHEN m.edit <> 'D' AND t.fault = 'truncated' THEN {CUT_SHORT} ELSE 0 END, 'audit': b.v.audit || m.letters}})
    FROM best b JOIN turns t ON t.c = b.c AND t.step = b.step + 1 JOIN moves m ON m.before = b.state AND (m.edit = 'D' OR t.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR m.initial = t.initial))
    GROUP BY b.c, m.after, b.step),
ended AS MATERIALIZED (SELECT c, min({{'cost': v.cost + {INSERT} * lack, 'audit': v.audit || repeat('I', lack)}}) AS v FROM (SELECT c, v, CASE state WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS lack FROM best) GROUP BY c),
edits AS (SELECT c, pos, edit, sum((edit <> 'I')::INT) OVER (PARTITION BY c ORDER BY pos) AS step FROM (SELECT c, unnest(string_split(v.audit, '')) AS edit, generate_subscripts(string_split(v.audit, ''), 1) AS pos FROM ended WHERE v.audit <> '')),
stays AS (SELECT e.c, pos, edit, t.role, coalesce(t.text, '') AS text, count(*) FILTER (edit <> 'K' OR t.initial <> 's') OVER (PARTITION BY e.c ORDER BY pos) AS place FROM edits e LEFT JOIN turns t ON t.c = e.c AND t.step = e.step AND e.edit <> 'I' WHERE edit <> 'D'),
mended AS (SELECT c, list({{'role': CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END, 'text': text}} ORDER BY pos) AS repaired FROM stays GROUP BY c),
pairs AS (SELECT c, turn, fault, lag(initial) OVER (PARTITION BY c ORDER BY step) || initial AS pair FROM turns),
figures AS (SELECT c, coalesce(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY c)
SELECT c, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, v.cost AS cost, v.audit AS audit, coalesce(repaired, []) AS repaired
FROM ended LEFT JOIN figures USING (c) LEFT JOIN mended USING (c) ORDER BY c
"""


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, number of its conversation for each row) of whole conversations, from batches in the order of conversations."""
    held: list[pa.RecordBatch] = []
    size = rows = 0

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, size, rows
        table = pa.Table.from_batches(held).combine_chunks()
        ids, none = pc.fill_null(table["conv_id"], 0).to_numpy(), pc.is_null(table["conv_id"]).to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])]))
        ends = np.append(new, len(ids))
        stop, at = len(new) - (not last), 0
        weight = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(table["text"]), 0).to_numpy())])[ends]
        while at < stop:  # as many conversations as fit, one at least
            to = at + 1
            while to < stop and ends[to + 1] - ends[at] <= BATCH_ROWS and weight[to + 1] - weight[at] <= BATCH_BYTES:
                to += 1
            yield table.slice(ends[at], ends[to] - ends[at]), np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
            at = to
        held = table.slice(ends[stop]).to_batches() if ends[stop] < len(ids) else []
        size, rows = int(weight[-1] - weight[stop]), int(ends[-1] - ends[stop])

    wait = 1
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.column("text").nbytes
        if rows >= BATCH_ROWS * wait or size >= BATCH_BYTES * wait:
            yield from cut(False)
            wait = max(1, 2 * rows // BATCH_ROWS, 2 * size // BATCH_BYTES)  # what is one conversation so far isn't looked through again until it has doubled
    if held:
        yield from cut(True)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    for table, c in _whole(batches):
        db.register("given", table.append_column("c", pa.array(c)))
        db.execute(TURNS)
        out = db.sql(REPAIR).to_arrow_table()
        db.unregister("given")
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        out = out.set_column(0, "conv_id", table["conv_id"].take(pa.array(first)))
        for b in out.combine_chunks().to_batches():
            yield b
    db.close()


def repair_conversations(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of every conversation.

    ``copies``: how often a row stands, once if not given; a conversation whose rows all stand 0 times has no turns."""
    bound_batches(turns.sparkSession)
    n = (F.lit(1) if copies is None else copies).cast("int")
    stood = lambda c: F.when(n > 0, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), stood("role").alias("role"), stood("text").alias("text"), n.alias("copies"))
    return rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id").mapInArrow(lean(_repair), OUT)


def damage(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Turns with planted faults and how often each stands: by a checksum of conv_id and turn one is dropped, emptied, cut
    short, repeated or given to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)


def damaged_repairs(turns: DataFrame) -> DataFrame:
    """The repairs of the damaged conversations, with a digest of the repaired turns."""
    found = repair_conversations(*damage(turns))
    told = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.withColumn("repaired_sha256", F.sha2(told.cast("binary"), 256)).drop("repaired")

"""Repair of conversations' turn structure, each distinct sequence of roles and faults solved once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stage, table
from .manifest import CRC

#: Costs of the edits; a truncated row that isn't deleted adds one.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a common signature are dealt to so many tasks when its audit joins them.
SALT = 16
#: What a signature says of a row: a role initial, in capitals where the text is truncated; `-` and `+` for other roles;
#: `x` for a row that has to go.
GONE, OTHER, OTHER_TRUNCATED = "x", "-", "+"


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits that leave roles of the form (s?(ua)+)?, the ASCII-least audit of several.

    Memoised over (row, state): `start` before any role, `s` after a system row, `u` where a user's row may come next or
    the end, `a` where an assistant's must. In each state one role may follow, but for the system's at the start, which
    only a kept row has; so an audit settles the roles. An insertion comes before a row that is kept or reroled, or at
    the end: before a deletion it would cost the same and make a greater audit, and no two of them in a row but at the
    end are ever cheapest. The rows are taken from the last, so the recursion is one call deep, however long they are.
    """
    after = {"start": "a", "s": "a", "u": "a", "a": "u"}  # the state once the expected role has come
    ending = {"start": (0, ""), "u": (0, ""), "a": (INSERT, "I"), "s": (2 * INSERT, "II")}

    @cache
    def best(row: int, state: str) -> tuple[int, str, int, str]:
        """(cost, letters, next row, next state): what to do first, of equal costs the least letters."""
        if row == len(signature):
            return (*ending[state], row, "end")
        kind = signature[row]
        options = []
        if kind != GONE:
            worse = TRUNCATED * (kind.isupper() or kind == OTHER_TRUNCATED)
            role = kind.lower()
            for letters, cost, here in (("", 0, state), ("I", INSERT, after[state])):
                expected = "a" if here == "a" else "u"
                if role == expected:
                    options.append((cost + worse, letters + "K", after[here]))
                elif role == "s" and here == "start":
                    options.append((cost + worse, letters + "K", "s"))
                options.append((cost + worse + REROLE, letters + "R", after[here]))
        options.append((DELETE, "D", state))
        cost, letters, then = min((cost + best(row + 1, then)[0], letters, then) for cost, letters, then in options)
        return cost, letters, row + 1, then

    for row in range(len(signature), -1, -1):
        for state in after:
            best(row, state)
    row, state, audit = 0, "start", []
    while state != "end":
        _, letters, row, state = best(row, state)
        audit.append(letters)
    return best(0, "start")[0], "".join(audit)


def judged(rows: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text, at, fault, breaks, code) of rows(key, conv_id, turn, role, text).

    at is the row's place in its conversation, by turn (nulls first), then role, then text; fault its first one of
    blank, duplicate and truncated, else null; breaks says whether the role may not follow the one before it.
    """
    order = ("turn", "role", "text")
    along = Window.partitionBy("key").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    same = Window.partitionBy("key", "role", "text").orderBy("at")
    blank, cut = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    placed = rows.withColumn("at", F.row_number().over(along)).withColumn("before", F.lag(initial).over(Window.partitionBy("key").orderBy("at")))
    fault = F.when(blank, "blank").when(F.row_number().over(same) > 1, "duplicate").when(cut, "truncated")
    breaks = F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")
    known = placed.withColumns({"fault": fault, "breaks": breaks})
    truncated = F.col("fault").eqNullSafe("truncated")
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(initial.isin("s", "u", "a"), F.when(truncated, F.upper(initial)).otherwise(initial)).when(truncated, OTHER_TRUNCATED).otherwise(OTHER)
    return known.withColumn("code", code)


def solutions(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature, solved once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [solve(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in done], pa.int64()), pa.array([a for _, a in done], pa.string())], names=["signature", "cost", "audit"])

    return signatures.select("signature").distinct().mapInArrow(run, "signature string, cost long, audit string")


def audits(rows: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of judged rows."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"])  # two numbers' worth a row
    spread = F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count_distinct("turn")
    figures = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    told = rows.groupBy("key").agg(F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"), *figures, F.count_if("breaks").alias("illegal"), F.array_join(ordered, "").alias("signature"))
    told = stage(told.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT))))
    solved = solutions(told).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return told.join(solved, ["signature", "salt"]).select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def replayed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(key, edit, role, text): the repaired rows of each conversation, in order, side by side in one partition.

    The audit goes ahead of its conversation's rows into the same partition; rows are edited as they stream by, so no
    conversation is ever held whole.
    """
    heads = plans.select("key", F.lit(0).alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(rows.select("key", "at", "role", "text"))
    dealt = both.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, todo, expected = None, "", "user"
        step = 0
        for batch in batches:
            out: list[tuple] = []
            for k, at, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "role", "text"))):
                if at == 0:
                    key, todo, expected, step = k, text, "user", 0
                else:
                    letter = todo[step]
                    step += 1
                    if letter != "D":
                        role = role if letter == "K" else expected
                        expected = "assistant" if role[:1] == "u" else "user"
                        out.append((k, letter, role, text))
                while step < len(todo) and todo[step] == "I":
                    out.append((key, "I", expected, ""))
                    expected = "assistant" if expected == "user" else "user"
                    step += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["key", "edit", "role", "text"])

    return dealt.mapInArrow(run, "key string, edit string, role string, text string")


def key_of() -> Column:
    """What a conversation's rows share, a null conv_id included."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired rows(key, edit, role, text), audits()) of the conversations of rows(conv_id, turn, role, text).

    A row's first fault counts: blank (nothing but ASCII white space), duplicate (its role and text were there earlier),
    truncated (the last character that isn't white space is none of `.!?`). The cheapest edits that leave roles of the
    form (s?(ua)+)? by their initials are found and replayed: Keep 0, Rerole to user or assistant 2, Delete 3 (blank and
    duplicate rows have to go), Insert an empty row 2, 1 for each truncated row that stays; ties go to the ASCII-least
    audit. Null and empty texts are blank; a null or empty role is like one unknown, and can't be kept; equal turns go by
    role, then text, repeated rows one after the other; a null conv_id is a conversation; no rows give none; other
    columns are ignored. A conversation's texts pass through one task as a stream, its signature (a letter a row) is a value.
    """
    blankless = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    placed = stage(judged(rows.select(key_of().alias("key"), F.col("turn").cast("long").alias("turn"), blankless("role"), blankless("text"))))
    plans = stage(audits(placed))
    return replayed(placed, plans), plans


def hashed(repaired: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of replayed()'s rows: lowercase hex of their `role:text`, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text"))):
                if state is None or k != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["key", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "repaired_sha256"])

    return repaired.mapInArrow(run, "key string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), nulls of role and text a space, damaged by crc32(`conv_id:turn`) % 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, audit and digest of every conversation, damaged and repaired; nulls, ties and repeats as in repair().

    A conversation that the damage leaves without rows has zeros, an empty audit and the empty text's digest; an empty
    table gives no rows.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired, plans = repair(damaged(rows))
    told = plans.join(hashed(repaired), "key", "left")
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    whole = rows.select("conv_id", key_of().alias("key")).distinct().join(told, "key", "left")
    empty = hashlib.sha256().hexdigest()
    return whole.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in figures), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op12_sql() -> str:
    """The same in SQL: the states' costs and audits from each conversation's last row to its first."""
    after, value = {"start": "a", "s": "a", "u": "a", "a": "u"}, "{{'c': {0} + {2}.c, 'a': '{1}' || {2}.a}}"

    def options(state: str) -> str:
        found = [f"CASE WHEN true THEN {value.format(DELETE, 'D', state)} END"]
        for letters, cost, here in (("", 0, state), ("I", INSERT, after[state])):
            expected, then = "a" if here == "a" else "u", after[here]
            found.append(f"CASE WHEN role = '{expected}' THEN {value.format(f'{cost} + worse', letters + 'K', then)} END")
            found.append(f"CASE WHEN role <> '{GONE}' THEN {value.format(f'{cost + REROLE} + worse', letters + 'R', then)} END")
        if state == "start":
            found.append(f"CASE WHEN role = 's' THEN {value.format('worse', 'K', 's')} END")
        return f"list_sort(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))[1] AS \"{state}\""

    states = ("start", "s", "u", "a")
    quoted = {s: f'"{s}"' for s in states}
    step = ", ".join(options(s).replace("|| start.a", '|| "start".a').replace("+ start.c", '+ "start".c') for s in states)
    return f"""
WITH RECURSIVE original AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
damaged AS (
  SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM original, range(2) AS copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
counted AS (SELECT *, row_number() OVER (PARTITION BY key, role, text ORDER BY pos) AS copy FROM placed),
judged AS (
  SELECT *, left(role, 1) AS initial, (lag(left(role, 1)) OVER (PARTITION BY key ORDER BY pos) || left(role, 1)) NOT IN ('su', 'ua', 'au') AS breaks,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN copy > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault FROM counted),
coded AS (
  SELECT key, pos, CASE WHEN fault IN ('blank', 'duplicate') THEN '{GONE}' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE '{OTHER}' END AS role,
    CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS worse FROM judged),
figures AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (breaks) AS illegal,
    max(pos) AS n FROM judged GROUP BY key),
best AS (
  SELECT key, n + 1 AS pos, {{'c': 0, 'a': ''}} AS {quoted["start"]}, {{'c': {2 * INSERT}, 'a': 'II'}} AS s, {{'c': 0, 'a': ''}} AS u, {{'c': {INSERT}, 'a': 'I'}} AS a FROM figures
  UNION ALL SELECT b.key, b.pos - 1, {step} FROM best b JOIN coded c ON c.key = b.key AND c.pos = b.pos - 1),
solved AS (SELECT key, "start".c AS cost, "start".a AS audit FROM best WHERE pos = 1),
letters AS (SELECT key, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS k FROM solved WHERE audit <> ''),
consuming AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY key ORDER BY k) AS pos,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY key ORDER BY k) AS out FROM letters),
replayed AS (
  SELECT l.key, l.k, l.out, l.letter, CASE WHEN letter = 'K' THEN j.role END AS kept, CASE WHEN letter = 'I' THEN '' ELSE j.text END AS text,
    max(CASE WHEN l.out = 1 AND letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.key) AS first
  FROM consuming l JOIN judged j ON j.key = l.key AND j.pos = greatest(l.pos, 1) WHERE letter <> 'D'),
repaired AS (
  SELECT key, sha256(string_agg(coalesce(kept, CASE WHEN (out - first) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY k)) AS h
  FROM replayed GROUP BY key)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM original) o LEFT JOIN figures f USING (key) LEFT JOIN solved v USING (key) LEFT JOIN repaired r USING (key)
"""

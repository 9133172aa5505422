"""Repair of conversations to the role order (system? (user assistant)+)? at the least cost, in DataFrame operations only.

Window functions flag each row's first fault; the sorted turns of a conversation are collected and folded by
``aggregate``. The fold carries four states, what the repaired roles so far end in: nothing, the system turn, a user
turn or an assistant turn. Each is a struct (cost, edits) and the cheapest way into a state is a ``least`` of structs, so
that ties go to the ASCII-least edits. Comparing prefixes is safe: of two ways with one cost into one state neither is the
beginning of the other, as all that could follow without using up a turn is an insertion, and those cost.

A conversation is one row of the result, with all its turns and its edits, and so is the unit of work: rows are dealt by
conv_id once, and conversations only as large as one row may be are repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import let, table

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Edits as carried: delete, insert a user or assistant turn, keep, rerole to user or assistant. Their order in ASCII is
#: that of the audit's initials D, I, K, R; two letters of one initial never compete, as only one of them fits a state.
CARRIED, INITIALS = "DIJKRS", "DIIKRR"
STATES = ("none", "system", "user", "assistant")
FAR = 1 << 40
SPACES = " \t\n\x0b\x0c\r"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text alone, whatever other columns there are; a null role or text is one space."""
    one_space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *one_space)


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with their damage by crc32("conv_id:turn") % 20 and ``alive``: 0 drops a row (it stays as not alive, so
    that its conversation does), 1 empties the text, 2 takes out its ends of sentences, 3 repeats the row, 4 makes it the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = _turns(conversations).withColumn("damage", F.crc32(F.encode(key, "UTF-8")) % 20)
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("damage") != 0).alias("alive"), (F.col("damage") == 3).alias("twice"))
    return rows.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("twice", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """The rows with the number of times their role and text were seen, initial, fault (0: none), whether the pair with the turn before is illegal, and whether the turn's
    number is new. Duplicates are seen by a window over (conversation, role, text): no conversation is compared pair by pair.

    ``repartition`` deals by conv_id, which serves both windows and the grouping after them, so rows move once.
    """
    alike = Window.partitionBy("conv_id", "alive", "role", "text").orderBy(F.asc_nulls_first("turn"))
    order = Window.partitionBy("conv_id", "alive").orderBy(F.asc_nulls_first("turn"), "role", "text")
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    out = rows.repartition("conv_id").withColumn("seen", F.row_number().over(alike)).withColumns({"initial": F.substring("role", 1, 1), "fault": fault})
    before = F.lag("initial").over(order)
    new = F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(order) == F.col("turn"), F.lit(False))
    return out.withColumns({"illegal": F.coalesce(~F.concat(before, "initial").isin("su", "ua", "au"), F.lit(False)), "new": new})


def _after(state: Column, cost: Column | int, edit: str) -> Column:
    return F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["edits"], F.lit(edit)).alias("edits"))


def _states(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(none.alias("none"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _inserted(s: Column) -> Column:
    """States after any insertions that may pay: one turn, or a user and an assistant turn."""
    user = F.least(s["user"], *(_after(s[k], INSERT, "I") for k in ("none", "system", "assistant")))
    return _states(s["none"], s["system"], user, F.least(s["assistant"], _after(user, INSERT, "J")))


def _turn(s: Column, t: Column) -> Column:
    """States after one more turn, deleted or (if it is neither blank nor a duplicate) kept or given another role."""
    stays = ~t["fault"].isin(BLANK, DUPLICATE)
    cut = F.when(t["fault"] == TRUNCATED, CUT).otherwise(0)
    gone = {k: _after(s[k], DELETE, "D") for k in STATES}
    before_user = F.least(s["none"], s["system"], s["assistant"])
    user = F.when(t["initial"] == "u", _after(before_user, cut, "K")).otherwise(_after(before_user, cut + REROLE, "R"))
    assistant = F.when(t["initial"] == "a", _after(s["user"], cut, "K")).otherwise(_after(s["user"], cut + REROLE, "S"))
    return _states(
        gone["none"], F.least(gone["system"], F.when(stays & (t["initial"] == "s"), _after(s["none"], cut, "K"))),
        F.least(gone["user"], F.when(stays, user)), F.least(gone["assistant"], F.when(stays, assistant)),
    )


def _cheapest(turns: Column) -> Column:
    """(cost, edits) of the cheapest repair of sorted turns."""
    far = F.struct(F.lit(FAR).cast("long").alias("cost"), F.lit("").alias("edits"))
    start = _states(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("edits")), far, far, far)
    return F.aggregate(turns, _inserted(start), lambda s, t: let(_turn(s, t), _inserted), lambda s: F.least(s["none"], s["assistant"]))


def _repaired(edits: Column, turns: Column) -> Column:
    """The turns (role, text) that edits make of turns: each turn's own edit follows the insertions before it."""

    def line(role: Column | str, text: Column | str) -> Column:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(as_column(role).alias("role"), as_column(text).alias("text"))

    def lines(edit: Column, t: Column) -> Column:
        own = F.right(edit, F.lit(1))
        kept = F.when(own == "K", line(t["role"], t["text"])).when(own == "R", line("user", t["text"])).when(own == "S", line("assistant", t["text"]))
        return F.array(F.when(edit.contains("I"), line("user", "")), F.when(edit.contains("J"), line("assistant", "")), kept)

    tail = F.regexp_extract(edits, "[IJ]*$", 0)
    ends = F.array(F.when(tail.contains("I"), line("user", "")), F.when(tail.contains("J"), line("assistant", "")))
    each = F.zip_with(F.regexp_extract_all(edits, F.lit("([IJ]*[DKRS])"), F.lit(1)), turns, lines)
    return F.filter(F.concat(F.flatten(each), ends), lambda x: x.isNotNull())


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired turns.

    ``rows`` has conv_id, turn, role, text as ``_turns`` gives them and ``alive`` (rows that are not count for nothing but
    let their conversation appear). Turns go by number (nulls first), then role and text; repeated rows are duplicates. A
    null conv_id is a conversation like others. Roles other than those beginning with s, u or a cannot be kept. Empty and
    very long texts are turns like others. A conversation without turns has zeros, no edits and no repaired turns; an
    empty table gives no rows.
    """
    turn = F.struct("turn", "role", "text", "seen", "initial", "fault")
    count = lambda condition: F.count(F.when(F.col("alive") & condition, 1)).alias
    alive = F.when(F.col("alive"), F.col("turn"))
    sums = [count(F.col("fault") == f)(n) for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))]
    gaps = F.coalesce(F.max(alive) - F.min(alive) + 1 - F.count(F.when(F.col("alive") & F.col("new"), 1)), F.lit(0)).alias("gaps")
    by = faults(rows).groupBy("conv_id").agg(gaps, *sums, count(F.col("illegal"))("illegal"), F.sort_array(F.collect_list(F.when(F.col("alive"), turn))).alias("turns"))  # the turns of one conversation
    best = by.withColumn("best", _cheapest(F.col("turns")))
    audit = F.translate("best.edits", CARRIED, INITIALS)
    return best.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), audit.alias("audit"), _repaired(F.col("best.edits"), F.col("turns")).alias("repaired"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return repair(damaged(table(spark, sf_dir, "conversations"))).withColumn("repaired", F.sha2(F.array_join(lines, "\n"), 256)).withColumnRenamed("repaired", "repaired_sha256")


def _plus(state: str, cost: int | str, edit: str) -> str:
    return f"lpad((left({state}, 9)::bigint + {cost})::varchar, 9, '0') || substr({state}, 10) || '{edit}'"


#: crc32 of an ASCII string by its bits.
CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({}, ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
#: The same least costs by recursion over a conversation's rows; a state is its cost in nine digits and its edits.
OP13_SQL = f"""
with recursive src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as d from conversations),
dam as (select *, row_number() over () as rid from (select conv_id, turn, case when d = 4 then 'user' else role end as role, case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when d = 3 then [0, 1] else [0] end) as copy from src where d <> 0)),
ends as (select *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last, left(role, 1) as initial,
  row_number() over (partition by conv_id order by turn nulls first, role, text, rid) as pos,
  row_number() over (partition by conv_id, role, text order by turn nulls first, rid) as seen from dam),
r as (select *, case when last = '' then 1 when seen > 1 then 2 when last not in ('.', '!', '?') then 3 else 0 end as fault, lag(initial) over (partition by conv_id order by pos) || initial as pair from ends),
f(conv_id, pos, n, s, u, a) as (
  select distinct conv_id, 0::bigint, '000000000', '900000000', '000000002I', '000000004IJ' from conversations
  union all
  select conv_id, pos, n, s, u2, least(a, {_plus('u2', INSERT, 'J')}) from (
    select *, least(u, {_plus('n', INSERT, 'I')}, {_plus('s', INSERT, 'I')}, {_plus('a', INSERT, 'I')}) as u2 from (
      select r.conv_id, r.pos, {_plus('f.n', DELETE, 'D')} as n,
        least({_plus('f.s', DELETE, 'D')}, case when k.stays and initial = 's' then {_plus('f.n', 'k.cut', 'K')} end) as s,
        least({_plus('f.u', DELETE, 'D')}, case when k.stays then case when initial = 'u' then {_plus('least(f.n, f.s, f.a)', 'k.cut', 'K')} else {_plus('least(f.n, f.s, f.a)', 'k.cut + 2', 'R')} end end) as u,
        least({_plus('f.a', DELETE, 'D')}, case when k.stays then case when initial = 'a' then {_plus('f.u', 'k.cut', 'K')} else {_plus('f.u', 'k.cut + 2', 'S')} end end) as a
      from f join r on r.conv_id is not distinct from f.conv_id and r.pos = f.pos + 1, lateral (select fault not in (1, 2) as stays, case when fault = 3 then 1 else 0 end as cut) k))),
best as (select conv_id, max_by(least(n, a), pos) as b from f group by conv_id),
plan as (select conv_id, left(b, 9)::bigint as cost, substr(b, 10) as edits from best),
line as (
  select p.conv_id, t.i * 4 + k.k as place, case k.k when 0 then 'user:' when 1 then 'assistant:' else case right(t.e, 1) when 'K' then r.role when 'R' then 'user' else 'assistant' end || ':' || r.text end as txt
  from (select conv_id, unnest(regexp_extract_all(edits, '[IJ]*[DKRS]')) as e, generate_subscripts(regexp_extract_all(edits, '[IJ]*[DKRS]'), 1) as i, from plan) t
  join plan p on p.conv_id is not distinct from t.conv_id join r on r.conv_id is not distinct from t.conv_id and r.pos = t.i, (select unnest([0, 1, 2]) as k) k
  where (k.k = 0 and contains(t.e, 'I')) or (k.k = 1 and contains(t.e, 'J')) or (k.k = 2 and right(t.e, 1) <> 'D')
  union all
  select conv_id, 4000000000 + k, case k when 0 then 'user:' else 'assistant:' end from plan, (select unnest([0, 1]) as k) k where contains(regexp_extract(edits, '[IJ]*$'), case k when 0 then 'I' else 'J' end)),
text as (select conv_id, string_agg(txt, chr(10) order by place) as txt from line group by conv_id),
cnt as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from r group by conv_id)
select p.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cost, translate(edits, '{CARRIED}', '{INITIALS}') as audit, sha256(coalesce(txt, '')) as repaired_sha256
from plan p left join cnt on cnt.conv_id is not distinct from p.conv_id left join text on text.conv_id is not distinct from p.conv_id
"""

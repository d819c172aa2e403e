"""Chat formatting by a grammar that is parsed again, with DataFrame operations only.

Grammar of a formatted conversation::

    conversation = turn*
    turn         = "### " role ": " text "\n</turn>\n"

``###`` and ``</turn>`` are control strings. A text holds them after a backslash only; parsing takes one
backslash away, and a turn whose text has a bare control string is none. Every turn is rendered as it is and parsed again; where the parser doesn't give back
the same turn (or another number of them), the content conflicts and the turn is rendered with one more backslash before each control string and parsed and
compared once more. A control string after n backslashes becomes one after n + 1, and only n = 0 ends a turn or is bare, so that round always reads back; the
operator fails if one does not, as it does where a whole conversation isn't parsed back to its turns. The text is followed by a newline, so a backslash at its
end can't reach the closing mark. Roles other than letters, digits, ``_`` and ``-`` are written as ``=`` and their base64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "\n</turn>\n"
CONTROL = ("###", "</turn>")
#: An end of a turn that no backslash guards, a control string with its backslashes, one that a backslash guards. Runs of backslashes
#: are entered at their first one and never given back, so a text is read once.
_BOUNDARY = r"(?<=\n)</turn>\n"
_CONTROL, _GUARDED = r"(?<!\\)(\\*+)(###|</turn>)", r"(?<!\\)\\(\\*+)(###|</turn>)"
#: Times that a conflicting turn is escaped before the operator gives up.
ROUNDS = 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _GUARDED, "$1$2")


def _bare(text: Column) -> Column:
    """Whether a text, read from the left, holds a control string that no backslash guards."""
    rest = F.regexp_replace(text, _GUARDED, "\x01")
    return rest.contains(CONTROL[0]) | rest.contains(CONTROL[1])


def _role_mark(role: Column) -> Column:
    return F.when(role.rlike(r"\A[A-Za-z0-9_-]+\z"), role).otherwise(F.concat(F.lit("="), F.regexp_replace(F.base64(F.encode(role, "UTF-8")), r"\s", "")))


def _piece(role: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), _role_mark(role), F.lit(": "), body, F.lit(END))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text): the deterministic parser, for whole conversations or single turns. What is no turn by the grammar is null."""
    parts = F.split(formatted, _BOUNDARY)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p):
        mark = F.regexp_extract(p, r"\A### ([A-Za-z0-9_=+/-]*): ", 1)
        role = F.when(mark.startswith("="), F.decode(F.unbase64(F.substring(mark, 2, 1 << 30)), "UTF-8")).otherwise(mark)
        body = p.substr(F.length(mark) + 7, F.length(p) - F.length(mark) - 7)
        whole = p.startswith(F.concat(F.lit("### "), mark, F.lit(": "))) & ~_bare(body)
        return F.when(whole, F.struct(role.alias("role"), unescape(body).alias("text")))

    return F.transform(parts, turn)


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per turn with its place, its piece of the output and where its text stands.

    Null roles and texts are empty. Turns go by turn (null last), then role, then text; repeated rows stay.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source, bodies = F.array(F.struct(F.col("role"), F.col("text"))), [F.col("text")]
    for _ in range(ROUNDS):
        bodies.append(escape(bodies[-1]))
    piece = F.raise_error(F.lit("a turn can't be escaped so that it reads back")).cast("string")
    for body in reversed(bodies):  # the first rendering that the parser reads back as its source
        piece = F.when(F.coalesce(parse_turns(_piece(F.col("role"), body)) == source, F.lit(False)), _piece(F.col("role"), body)).otherwise(piece)
    t = t.withColumn("piece", piece).withColumn("escaped", F.col("piece") != _piece(F.col("role"), F.col("text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    t = t.withColumn("place", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.col("start") + F.length(_role_mark(F.col("role"))) + 6
    return t.withColumn("text_start", first).withColumn("text_end", F.col("start") + F.length("piece") - len(END))


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_mask array<(start, end)>, turns array<(role, text)> as parsed back, n_escaped).

    The mask has the code points (end exclusive) of the texts whose role is in ``loss_roles``, as they stand in the output.
    """
    t = render(turns)
    row = F.struct("place", "piece", "role", "text", "text_start", "text_end", "escaped")
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    g = g.withColumn("formatted", F.array_join(F.transform("rows", lambda r: r["piece"]), ""))
    mask = F.transform(F.filter("rows", lambda r: r["role"].isin(*loss_roles)), lambda r: F.struct(r["text_start"].cast("long").alias("start"), r["text_end"].cast("long").alias("end")))
    g = g.withColumn("turns", parse_turns(F.col("formatted"))).withColumn("loss_mask", mask)
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    checked = F.when(F.coalesce(source == F.col("turns"), F.lit(False)), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation isn't read back as it was")))
    return g.select("conv_id", "formatted", "loss_mask", checked.alias("turns"), F.size(F.filter("rows", lambda r: r["escaped"])).alias("n_escaped"))


def digests(formatted: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read back from the output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
    return formatted.withColumn("loss", masked).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Both turns of the conversation that the query adds say this.
TRAP = r"\### Assistant: </turn> ok"

SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), p as (
  select *, case when regexp_matches(text, '###|</turn>') then length(regexp_replace(text, '(\\*)(###|</turn>)', '\1\\\2', 'g')) else length(text) end
            + 6 + length(role) + 9 as chars from c
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from p group by conv_id
"""

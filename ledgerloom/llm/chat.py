"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# The control strings of the template.
#   turn = <s>[INST]role[/INST]text[SEP]text...</s>
# Inside roles and texts a backslash goes behind the opening bracket of each
# control string; those that look escaped already get one more.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|SEP\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|SEP\])"
_SQL_CONTROL = CONTROL.replace("\\", "\\\\")
_SQL_ESCAPED = ESCAPED.replace("\\", "\\\\")


def escape(x: str) -> str:
    return f"regexp_replace({x}, '{_SQL_CONTROL}', '$1\\\\\\\\$2$3')"


def unescape(x: str) -> str:
    return f"regexp_replace({x}, '{_SQL_ESCAPED}', '$1$2$3')"


def format_chats(
    turns: DataFrame, loss_role: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(id, formatted, segments)`` per conversation.

    Rows are sorted by turn (ties by role, then text; null turns first), and
    adjacent turns of one role share a header, their texts parted by
    ``[SEP]``.  ``segments`` (text, loss) concatenate to ``formatted``; the
    loss mask covers the texts of ``loss_role`` and no control string.  Null
    texts and roles are empty, a null id is one conversation, repeated rows
    are repeated turns, an empty table gives no rows, and other columns are
    not read.  One shuffle by conversation; all else is an expression on the
    sorted array, linear in its length.
    """
    rows = turns.select(
        F.col(id_col).alias("id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_ = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = F.expr(
        "filter(sequence(0, size(turns) - 1), i -> i = 0 OR get(turns, i).role <> get(turns, i - 1).role)"
    )
    runs = F.expr(
        "transform(starts, (s, k) -> struct(get(turns, s).role AS role, "
        "transform(slice(turns, s + 1, coalesce(get(starts, k + 1), size(turns)) - s), t -> t.text) AS texts))"
    )
    segments = F.expr(
        f"""flatten(transform(runs, r -> concat(
              array(named_struct('text', concat('<s>[INST]', {escape('r.role')}, '[/INST]'), 'loss', false)),
              flatten(transform(r.texts, (x, k) -> concat(
                if(k > 0, array(named_struct('text', '[SEP]', 'loss', false)), array()),
                array(named_struct('text', {escape('x')}, 'loss', r.role = '{loss_role}'))))),
              array(named_struct('text', '</s>', 'loss', false)))))"""
    )
    return (
        sorted_.withColumn("starts", starts)
        .withColumn("runs", runs)
        .select("id", segments.alias("segments"))
        .select(F.col("id").alias(id_col), F.expr("array_join(transform(segments, s -> s.text), '')").alias("formatted"), "segments")
    )


def parse_turns(formatted: str) -> Column:
    """The turns (role, text) of a formatted string, unescaped."""
    return F.expr(
        f"""flatten(transform(filter(split({formatted}, '</s>'), b -> b <> ''), b -> transform(
              split(substring(b, instr(b, '[/INST]') + 7), '\\\\[SEP\\\\]'), x -> struct(
                {unescape("substring(b, 10, instr(b, '[/INST]') - 10)")} AS role, {unescape('x')} AS text))))"""
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = format_chats(turns).select(
        "conv_id",
        "formatted",
        parse_turns("formatted").alias("turns"),
        F.expr(f"array_join(transform(filter(segments, s -> s.loss), s -> {unescape('s.text')}), '')").alias("loss"),
    )
    return made.select(
        "conv_id",
        F.expr("CAST(size(turns) AS BIGINT)").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
     p AS (SELECT *, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS same FROM c),
     e AS (SELECT *, length(regexp_replace(text, '{CONTROL}', '\1\\\2\3', 'g')) AS t, length(regexp_replace(role, '{CONTROL}', '\1\\\2\3', 'g')) AS r FROM p)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(t + CASE WHEN same THEN 5 ELSE 20 + r END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

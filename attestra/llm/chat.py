r"""Chat formatting by relational means only: no Python runs on the executors.

A conversation's rows become one string::

    ### user:\nHello</part>again</turn>\n### assistant:\nHi</turn>\n

Neighbouring rows of one role merge into one turn, whose parts ``</part>`` keeps
apart, so the rows can be read back. Inside texts and roles ``\``, ``#``, ``<``
(and ``:`` in roles) are written as ``\b``, ``\h``, ``\l`` and ``\c``: no text can
hold a control string, and :func:`unescape` gives the text back exactly.

Defined results: a null text or role counts as empty; rows of one (conv_id, turn)
are ordered by role, then text; repeated rows stay; a null turn sorts first; a null
conv_id is a conversation of its own; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import common

TURN_END = "</turn>\n"
PART = "</part>"
#: Escapes, the backslash first; read back in the opposite order.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for raw, code in pairs:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for raw, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: array of (start, length) in code points of ``formatted``."""
    turns = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("turn").cast("long").alias("turn"),
                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            )
        ),
    )
    rows = conversations.groupBy("conv_id").agg(turns.alias("turns"))
    # Where a run of one role starts; each run is one turn of the format.
    rows = rows.withColumn(
        "starts",
        F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 OR turns[i].role <> turns[greatest(i - 1, 0)].role)"),
    )
    rows = rows.select(
        "conv_id",
        F.expr(
            "transform(starts, (s, j) -> named_struct('role', turns[s].role, 'texts', "
            "transform(slice(turns, s + 1, coalesce(get(starts, j + 1), size(turns)) - s), t -> t.text)))"
        ).alias("merged"),
    )
    # Segments in order: plain text of the format, or a part under the loss mask.
    segments = F.flatten(
        F.transform(
            "merged",
            lambda m: F.concat(
                F.array(_segment(F.concat(F.lit("### "), escape(m["role"], ROLE_ESCAPES), F.lit(":\n")), F.lit(False))),
                F.flatten(
                    F.transform(
                        m["texts"],
                        lambda t, k: F.array(
                            _segment(F.when(k > 0, F.lit(PART)).otherwise(F.lit("")), F.lit(False)),
                            _segment(escape(t), m["role"] == F.lit(loss_role)),
                        ),
                    )
                ),
                F.array(_segment(F.lit(TURN_END), F.lit(False))),
            ),
        )
    )
    rows = rows.select("conv_id", segments.alias("segments"))
    spans = F.expr(
        "aggregate(segments, named_struct('at', 0L, 'spans', cast(array() AS array<struct<start:bigint,length:bigint>>)), "
        "(a, s) -> named_struct('at', a.at + char_length(s.body), 'spans', "
        "if(s.loss, concat(a.spans, array(named_struct('start', a.at, 'length', cast(char_length(s.body) AS bigint)))), a.spans)), "
        "a -> a.spans)"
    )
    return rows.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["body"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def _segment(body: Column, loss: Column) -> Column:
    return F.struct(body.alias("body"), loss.alias("loss"))


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """Reads rows back: conv_id, turns (array of role, text), loss_text."""
    blocks = F.expr("filter(split(formatted, '</turn>\\n'), b -> b <> '')")
    read = formatted.withColumn("blocks", blocks)
    turns = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                F.split(F.substring(b, F.locate(":", b) + 2, F.length(b)), PART),
                lambda t: F.struct(
                    unescape(F.substring(b, F.lit(5), F.locate(":", b) - 5), ROLE_ESCAPES).alias("role"), unescape(t).alias("text")
                ),
            ),
        )
    )
    loss = F.array_join(
        F.transform(
            "loss_spans",
            lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))),
        ),
        "",
    )
    return read.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from the format, as counts and hashes."""
    return parse_formatted(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE_TEXT = "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """Adds conversation -7, whose texts imitate control strings."""
    spark: SparkSession = conversations.sparkSession
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(format_conversations(with_probe(common.table(spark, sf_dir, "conversations"))))


#: formatted_chars follows the format's own fixed strings: "### ", ":\n", "</turn>\n", "</part>".
OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), d AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS pos FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + CASE WHEN before = role THEN 7 ELSE 14
    + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) END) AS BIGINT) AS formatted_chars
FROM d GROUP BY conv_id
"""

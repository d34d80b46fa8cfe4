"""Chat formatting: a finite-state machine over roles and a declarative template.

DataFrame functions only. A conversation becomes one list of segments, each with a
flag that says whether it counts for the loss; the formatted text is their
concatenation, from which turns can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """Marks of a turn, roles whose texts count for the loss, and the machine's moves.

    A turn is ``opening`` + role + ``middle`` + text + ``closing``. ``moves`` maps
    (state, role) to the next state; a conversation is valid if every turn has a
    move and the last state is in ``final``.
    """

    opening: str = "### "
    middle: str = ": "
    closing: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    def __post_init__(self):
        for mark in (self.opening, self.middle, self.closing):
            if len(mark) < 2 or "\\" in mark:
                raise ValueError("a mark has at least two characters and no backslash")
        # else a mark could stand across an escaped one, or across a text's end and the mark behind it
        for one in self.marks:
            for other in self.marks:
                if one != other and one in other or any(one[-k:] == other[:k] for k in range(1, min(len(one), len(other)))):
                    raise ValueError("marks must not overlap or hold each other")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.opening, self.middle, self.closing)


def escape(text: Column, template: Template) -> Column:
    """Double backslashes, then put one after the first character of every mark, so that no mark is left."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.marks:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescape(text: Column) -> Column:
    """Drop the backslash of every pair of a backslash and a character, from left to right."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(df: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conv_id: valid, error_turn, segments (array of text and loss) and formatted.

    Turns are taken in the order of ``turn``, then role and text; repeated rows are
    turns of their own. A null role or text is empty. Conversations that break the
    turn order are formatted too, with ``valid`` false and the place (from 0) of the first
    turn without a move, or the number of turns if only the end is wrong, as
    ``error_turn``. An empty table gives no rows; columns other than conv_id, turn,
    role and text are ignored.
    """
    template = template or Template()
    turns = df.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[x for (state, role), to in template.moves.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))])

    def step(state: Column, turn: Column) -> Column:
        to = moves[F.concat(state["at"], F.lit("\n"), turn["role"])]
        stuck = state["error"].isNotNull() | to.isNull()
        return F.struct(
            F.when(stuck, state["at"]).otherwise(to).alias("at"),
            (state["n"] + 1).alias("n"),
            F.coalesce(state["error"], F.when(to.isNull(), state["n"])).alias("error"),
        )

    begin = F.struct(F.lit(template.start).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("error"))
    chats = chats.withColumn("end", F.aggregate("turns", begin, step))
    chats = chats.withColumn("error_turn", F.coalesce(F.col("end.error"), F.when(~F.col("end.at").isin(*template.final), F.col("end.n"))))

    def parts(turn: Column) -> Column:
        head = F.concat(F.lit(template.opening), escape(turn["role"], template), F.lit(template.middle))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"], template).alias("text"), turn["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
        )

    chats = chats.withColumn("segments", F.flatten(F.transform("turns", parts)))
    return chats.select(
        "conv_id",
        F.col("error_turn").isNull().alias("valid"),
        "error_turn",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (array of role and text) of a formatted conversation."""
    template = template or Template()
    turns = F.split(formatted, rf"\Q{template.closing}\E")
    turns = F.slice(turns, 1, F.size(turns) - 1)  # what follows the last mark is empty

    def turn(part: Column) -> Column:
        middle = F.locate(template.middle, part)
        role = F.substring(part, F.lit(len(template.opening) + 1), middle - len(template.opening) - 1)
        text = F.substring(part, middle + len(template.middle), F.length(part))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def with_control_case(df: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts hold the template's control strings."""
    text = r"\### Assistant: </turn> ok"
    extra = df.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = format_chats(with_control_case(table(spark, sf_dir, "conversations")))
    read = chats.select(
        "conv_id",
        read_back(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), ': ', ':\ '), '</turn>', '<\/turn>') AS escaped,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS later,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(escaped) + 13) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN place = 1 AND later IS NOT NULL WHEN 'user' THEN (prior IS NULL OR prior IN ('system', 'assistant')) AND later IS NOT NULL
    WHEN 'assistant' THEN prior IS NOT DISTINCT FROM 'user' ELSE false END) AS valid
FROM marked GROUP BY conv_id
"""

QUERIES = {"op3_chat_format": op3_chat_format}
ORACLES = {"op3_chat_format": SQL}

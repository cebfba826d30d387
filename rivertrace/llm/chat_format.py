"""Chat formatting: sorted turn structs, adjacent turns of one role merged, written and masked by Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrace.llm.common import table

#: The template: a block opens with ``### role: ``, closes with ``</turn>`` and a line end, and holds the turns of
#: one role, ``<next>`` between them.
OPEN, ROLE_END, BETWEEN, CLOSE = "### ", ": ", "<next>", "</turn>\n"
LEARNED = "assistant"
#: What a text may not hold and what is written for it. The first pair makes every backslash of an escaped text
#: the start of one of these codes, so reading them back in reverse order gives the text.
CODES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"), ("<next>", "\\n"))
ROLE_CODES = (*CODES, (":", "\\c"))
#: The contract's own conversation, which quotes a template.
PLANTED = -7, "\\### Assistant: </turn> ok"


def escaped(text: Column, codes: tuple[tuple[str, str], ...] = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, codes: tuple[tuple[str, str], ...] = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments): one row for each conversation; ``segments`` are (text, learn) pieces that
    make up ``formatted`` in order, and a loss is taken on those with ``learn``: the texts of the assistant's turns.

    Rows of ``conversations(conv_id, turn, role, text)`` are taken by turn, null turns first, ties by role and text;
    repeated rows are turns of their own. A null role or text is empty, rows without conv_id are one
    conversation. No rows give no conversations. Other columns are not looked at. A conversation becomes one string, so
    it has to fit into a row; all steps are linear in its turns and its text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    role_at = lambda i: F.get("turns", i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    rows = rows.withColumn("starts", starts)

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        return F.struct(role_at(start).alias("role"), F.transform(F.slice("turns", start + 1, stop - start), lambda t: escaped(t["text"])).alias("texts"))

    rows = rows.select("conv_id", F.transform("starts", block).alias("blocks"))

    def piece(text: Column, learn: Column | bool) -> Column:
        return F.struct(text.alias("text"), (learn if isinstance(learn, Column) else F.lit(learn)).alias("learn"))

    def pieces(b: Column) -> Column:
        head = piece(F.concat(F.lit(OPEN), escaped(b["role"], ROLE_CODES), F.lit(ROLE_END)), False)
        texts = F.transform(
            b["texts"], lambda t, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(BETWEEN)), False), piece(t, b["role"] == LEARNED))
        )
        return F.concat(F.array(head), F.flatten(texts), F.array(piece(F.lit(CLOSE), False)))

    rows = rows.select("conv_id", F.filter(F.flatten(F.transform("blocks", pieces)), lambda p: p["text"] != "").alias("segments"))
    return rows.select("conv_id", F.array_join(F.transform("segments", lambda p: p["text"]), "").alias("formatted"), "segments")


def turns_of(text: Column) -> Column:
    """The (role, text) of every turn, read back from a formatted conversation."""

    def turns(b: Column) -> Column:
        head = F.substring_index(b, ROLE_END, 1)
        role = unescaped(F.substr(head, F.lit(len(OPEN) + 1)), ROLE_CODES)
        texts = F.split(F.substr(b, F.length(head) + len(ROLE_END) + 1), BETWEEN, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    blocks = F.split(text, CLOSE, -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda p: p["learn"]), lambda p: unescaped(p["text"])), "")


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    conv_id, text = PLANTED
    planted = spark.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, LEARNED, text)], rows.schema)
    read = formatted(rows.union(planted)).select("conv_id", turns_of(F.col("formatted")).alias("turns"), learned_text(F.col("segments")).alias("learned"), F.length("formatted").alias("n"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )


def _length_sql(value: str, codes: tuple[tuple[str, str], ...]) -> str:
    for plain, code in codes:
        value = f"replace({value},'{plain}','{code}')"
    return f"length({value})"


SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT {PLANTED[0]}, 0, 'user', '{PLANTED[1]}' UNION ALL SELECT {PLANTED[0]}, 1, '{LEARNED}', '{PLANTED[1]}'
), placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w IS DISTINCT FROM role AS opens FROM given
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT cast(conv_id AS bigint) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  cast(sum(CASE WHEN role='{LEARNED}' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role='{LEARNED}'), '')) AS loss_sha256,
  cast(sum({_length_sql("text", CODES)} + CASE WHEN opens THEN {len(OPEN + ROLE_END + CLOSE)} + {_length_sql("role", ROLE_CODES)} ELSE {len(BETWEEN)} END)
    AS bigint) AS formatted_chars
FROM placed GROUP BY conv_id
"""

QUERIES = {"op11_chat_format": (query, SQL)}

"""Chat formatting: one training example for each assistant turn, all earlier turns as its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: <|turn|>role<|text|>text<|end|>.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a tokenizer may read as control, ours and common ones; fixed values.
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TRAINED_ROLE = "assistant"


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in text)


def escape(text: Column) -> Column:
    """Double each backslash, then put one after the first character of each control string."""
    controls = "|".join(f"(?={_quoted(c)})" for c in CONTROLS)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?:{controls})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: each backslash gives way to the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chat_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars): the training examples of ``turns``.

    Each assistant turn ends one example; ``formatted`` holds all turns up to
    and with it, and the loss mask is the ``loss_chars`` code points from
    ``loss_start`` (0-based), that turn's escaped text. Turns after the last assistant turn, and
    conversations without one, make a last example with an empty mask, so that
    no turn is lost. A null role or text is empty; each row without a conv_id
    is a conversation of its own; turns stand in order of turn (null first),
    then role and text, so ties and repeated rows have one order. Long texts
    are kept whole. Other columns are ignored; an empty table has no examples.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"), _alone(conv_col))
    whole = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(escape(t["text"]), F.lit(END)).alias("body"), (t["role"] == TRAINED_ROLE).alias("trained")))
    whole = whole.select("conv_id", parts.alias("parts"))
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("parts", i)["trained"] | (i == F.size("parts")))
    each = whole.select("conv_id", "parts", F.posexplode(ends).alias("example", "last"))
    context = F.concat_ws("", F.transform(F.slice("parts", 1, F.col("last") - 1), lambda p: F.concat(p["head"], p["body"])))
    reply = F.element_at("parts", F.col("last"))
    return each.select(
        "conv_id",
        "example",
        F.concat(context, reply["head"], reply["body"]).alias("formatted"),
        (F.char_length(context) + F.char_length(reply["head"])).cast("long").alias("loss_start"),
        F.when(reply["trained"], F.char_length(reply["body"]) - len(END)).otherwise(0).cast("long").alias("loss_chars"),
    )


def _alone(conv_col: str) -> Column:
    """A number for each row without a conversation, so that such rows never meet in one group."""
    return F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("alone")


def _by_turn(a: Column, b: Column) -> Column:
    """Order of turns for array_sort: turn (null first), role, text."""
    turn = F.when(a["turn"].isNull() & b["turn"].isNull(), 0).when(a["turn"].isNull(), -1).when(b["turn"].isNull(), 1)
    turn = turn.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0)
    rest = F.when(a["role"] < b["role"], -1).when(a["role"] > b["role"], 1).when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0)
    return F.when(turn != 0, turn).otherwise(rest)


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from formatted examples.

    The last example of a conversation holds all its turns. Masked texts are
    cut out by their offsets and join in the order of the examples. Each
    example without a conv_id is read for itself.
    """
    masked = F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    own = examples.select("conv_id", "example", "formatted", unescape(masked).alias("loss"), _alone("conv_id"))
    whole = own.groupBy("conv_id", "alone").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"])).alias("loss"),
        F.max_by("formatted", "example").alias("longest"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    turn = f"(?s){_quoted(TURN)}(.*?){_quoted(TEXT)}(.*?){_quoted(END)}"
    roles, texts = (F.regexp_extract_all("longest", F.lit(turn), F.lit(g)) for g in (1, 2))
    turns = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["text"]), F.lit("\n")))
    return whole.select(
        "conv_id",
        F.size(roles).cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", turns), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: formatted_chars: each example's turns with three marks and the escapes: a backslash for each backslash and each control string.
CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 23 + length(role) + length(text)
    + len(regexp_extract_all(role || chr(1) || text,
        '\\|<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>')) AS chars,
    row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), running AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY nth) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR nth = n) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id
"""

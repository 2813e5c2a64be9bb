"""Chat formatting: conversations as one training text each, with a loss mask, and back again.

The template, one block per run of turns of one role:

    ### Assistant: first turn<next/>second turn</turn>
    ### User: ...</turn>

Roles user, assistant and system are written with a capital; any other role follows an equals sign.
Inside roles and texts each control string becomes a backslash and a letter, and a backslash becomes two;
no escaped text holds a control string, so a formatted text is split at its marks alone and every turn reads
back as it was. The loss mask is a flag per segment; segments joined are the formatted text.

Edge cases: a null text counts as empty and a null role as an empty role. Turns are ordered by
(turn, role, text), so rows with one turn number have a defined order, repeated rows stay, and a null turn is
the first. A null conv_id is a conversation of its own. An empty table gives no rows. Further columns are not read.
A conversation is one row of the result, so its text must fit in a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, NEXT, END = "### ", ": ", "<next/>", "</turn>"
_CODES = {"\\": "\\\\", "###": "\\h", NEXT: "\\n", END: "\\e", ": ": "\\c"}
_NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}


def escape(text: Column) -> Column:
    for plain, code in _CODES.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Undo `escape`. Doubled backslashes are set aside first, so that none of them begins a code."""
    parts = F.split(text, r"\\\\", -1)
    codes = list(_CODES.items())[1:]

    def plain(part: Column) -> Column:
        for text, code in codes:
            part = F.replace(part, F.lit(code), F.lit(text))
        return part

    return F.array_join(F.transform(parts, plain), "\\")


def role_name(role: Column) -> Column:
    name = F.concat(F.lit("="), escape(role))
    for plain, shown in _NAMES.items():
        name = F.when(role == plain, shown).otherwise(name)
    return name


def role_of(name: Column) -> Column:
    role = unescape(F.substr(name, F.lit(2)))
    for plain, shown in _NAMES.items():
        role = F.when(name == shown, plain).otherwise(role)
    return role


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, `blocks` (role, texts), `segments` (text, loss), `formatted`.

    Turns of a conversation are gathered in its mappers first, then once per conversation. Merging compares
    each turn with the one before and cuts runs out of the sorted array, so the work grows with the turns.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("turns.role"))
    starts = F.filter(
        F.transform(F.col("turns.role"), lambda role, i: F.when(~role.eqNullSafe(F.get("before", i)), i)),
        lambda i: i.isNotNull(),
    )
    chats = chats.withColumn("before", before).withColumn("starts", starts)

    def block(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get("starts", i + 1), F.size("turns"))
        run = F.slice("turns", start + 1, end - start)
        return F.struct(F.get("turns", start)["role"].alias("role"), run["text"].alias("texts"))

    chats = chats.select("conv_id", F.transform("starts", block).alias("blocks"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def marks(block: Column) -> Column:
        loss = block["role"] == "assistant"
        head = piece(F.concat(F.lit(HEAD), role_name(block["role"]), F.lit(COLON)), F.lit(False))
        texts = F.transform(
            block["texts"],
            lambda text, i: F.when(i == 0, F.array(piece(escape(text), loss))).otherwise(
                F.array(piece(F.lit(NEXT), F.lit(False)), piece(escape(text), loss))
            ),
        )
        return F.concat(F.array(head), F.flatten(texts), F.array(piece(F.lit(END + "\n"), F.lit(False))))

    segments = F.flatten(F.transform("blocks", marks))
    return chats.select("conv_id", "blocks", segments.alias("segments")).select(
        "conv_id", "blocks", "segments", F.array_join(F.col("segments.text"), "").alias("formatted")
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """Turns (role, text) in order, read from `formatted` alone, as column `turns` beside the other columns."""
    blocks = F.split("formatted", END + "\n", -1)

    def read(block: Column) -> Column:
        head = F.substring_index(block, COLON, 1)
        body = F.substr(block, F.length(head) + F.lit(len(COLON) + 1))
        role = role_of(F.substr(head, F.lit(len(HEAD) + 1)))
        return F.transform(
            F.split(body, NEXT, -1), lambda text: F.struct(role.alias("role"), unescape(text).alias("text"))
        )

    return chats.withColumn("turns", F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), read)))

"""Chat formatting that survives its own parser.

The template writes each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings
start with ``<|`` and may not stand in a text: the parser refuses them there. A text that the parser would not give back as it is, gets escaped: between ``<`` and ``|`` one backslash
more than stands there is written (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``), which the parser undoes by
taking one away; so escaping can always be undone and, once done, no control string is left in a text.
Rendering is checked by a grammar round trip: every turn is first rendered raw and reparsed; a turn that does not come back
is rendered escaped; the whole conversation is reparsed and compared, and if its turns still differ, all of its turns
are escaped. ``round_trip`` tells that the parse of the final text equals the source.

Everything is a column expression over one row per conversation (its turns, as an array); the only
shuffle brings the turns of a conversation together. Null roles and texts count as empty, a null
turn sorts first, equal turn numbers are ordered by role and text, a null id is an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
BREAK = "<|n|>"  # a line break inside a role
RAISE, LOWER = r"<(\\*)\|", r"<\\(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, RAISE, r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, LOWER, r"<$1|")


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(BREAK)), F.lit("\n"), body, F.lit(END))


def _read(block: Column) -> Column:
    """A block, without its end mark, as role and text. The role ends at the first line break."""
    inner = F.substr(block, F.lit(len(START) + 1))
    role = F.substring_index(inner, "\n", 1)
    raw = F.substr(inner, F.length(role) + 2)
    return F.struct(
        unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(raw).alias("text"),
        F.length(role).alias("n_role"), F.length(raw).alias("n_raw"),
    )


def parse(formatted: Column) -> Column:
    """The deterministic parser: blocks end at the end mark; each must begin with the start mark. Null if the text is none of ours."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    body = F.slice(blocks, 1, F.size(blocks) - 1)
    text = lambda b: F.substr(b, F.locate("\n", b) + 1)
    sound = (F.element_at(blocks, -1) == "") & F.forall(
        body, lambda b: F.startswith(b, F.lit(START)) & F.contains(b, F.lit("\n")) & ~F.contains(text(b), F.lit("<|")))
    return F.when(sound, F.transform(body, _read))


def _pairs(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(turns: DataFrame, train_on=("assistant",)) -> DataFrame:
    """Per conversation: ``conv_id``, ``formatted``, ``loss_spans`` (code points of the texts to learn), ``n_escaped``, ``round_trip``."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    chats = chats.withColumn("turns", _pairs(F.col("turns")))
    raw_reads = lambda t: F.coalesce(parse(render_turn(t["role"], t["text"])) [0]["text"].eqNullSafe(t["text"])
                                     & (F.size(parse(render_turn(t["role"], t["text"]))) == 1), F.lit(False))
    clean = lambda t: F.when(F.contains(t["text"], F.lit("<")), raw_reads(t)).otherwise(F.lit(True))  # noqa: E731  without "<" nothing can conflict
    once = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (~clean(t)).alias("escaped")))
    chats = chats.withColumn("turns", once)
    join = lambda every: F.array_join(F.transform("turns", lambda t: render_turn(
        t["role"], F.when(F.lit(every) | t["escaped"], escape(t["text"])).otherwise(t["text"]))), "")
    same = lambda formatted: F.coalesce(_pairs(parse(formatted)) == _pairs(F.col("turns")), F.lit(False))
    chats = chats.withColumn("formatted", join(False)).withColumn("agrees", same(F.col("formatted")))
    chats = chats.withColumns({
        "formatted": F.when(F.col("agrees"), F.col("formatted")).otherwise(join(True)),
        "n_escaped": F.when(F.col("agrees"), F.size(F.filter("turns", lambda t: t["escaped"]))).otherwise(F.size("turns")),
    }).withColumn("round_trip", F.col("agrees") | same(F.col("formatted")))
    return chats.select("conv_id", "formatted", loss_spans(F.col("formatted"), train_on).alias("loss_spans"), "n_escaped", "round_trip")


def loss_spans(formatted: Column, train_on=("assistant",)) -> Column:
    """Start and end, in code points, of the texts under the loss mask, found by the parser."""
    overhead = len(START) + 1 + len(END)
    walk = F.aggregate(
        parse(formatted), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + overhead + t["n_role"] + t["n_raw"]).alias("at"),
            F.when(t["role"].isin(*train_on), F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + len(START) + 1 + t["n_role"]).alias("start"), (acc["at"] + len(START) + 1 + t["n_role"] + t["n_raw"]).alias("end"),
            )))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return walk["spans"]


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, one span after another."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")

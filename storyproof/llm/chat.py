"""Chat formatting with a grammar round trip, in DataFrame operations only.

The template writes a turn as `<|turn|>` role `<|text|>` text `<|end|>`. A parser that knows nothing but these marks splits
the rendered conversation again. A turn whose marks, parsed back, don't give the same role and text is rendered anew with its
content escaped, and so is any content that escaping could be mistaken for: a tilde becomes `~0`, and the bar of a mark `~1`.
Escaped content holds no bar behind an angle bracket, so no mark, and undoing the escapes gives the source again. The whole
conversation is parsed then and compared with its source; if it differed, all its turns would be escaped, and if that differed
too, the query would fail rather than give a conversation that can't be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED = "assistant"


def escape(content: Column) -> Column:
    return F.replace(F.replace(content, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("<~1"))


def unescape(content: Column) -> Column:
    return F.replace(F.replace(content, F.lit("<~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END))


def _quoted(mark: str) -> str:
    return mark.replace("|", "\\|")


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation as array<struct<role,text>>, content unescaped.

    Everything up to an end mark is a turn; in it, what stands between the turn mark and the first text mark is the role.
    """

    def turn(x: Column) -> Column:
        at = F.locate(TEXT, x)
        return F.struct(unescape(F.substring(x, F.lit(len(TURN) + 1), at - len(TURN) - 1)).alias("role"), unescape(F.substring(x, at + len(TEXT), F.length(x))).alias("text"))

    return F.transform(F.split(F.substring(formatted, F.lit(1), F.length(formatted) - len(END)), _quoted(END)), turn)


def rendered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with escaped, their rendering with escapes, and rendered: without, if that parses back.

    The unescaped rendering of a turn is kept only if the parser finds exactly one turn in it, with the same role and text.
    """
    source = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain, escaped = render(F.col("role"), F.col("text")), render(escape(F.col("role")), escape(F.col("text")))
    back = parse(plain)
    same = (F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))
    return source.withColumn("escaped", escaped).withColumn("rendered", F.when(same, plain).otherwise(escaped))


def conversations(rows: DataFrame) -> DataFrame:
    """One row for each conv_id: formatted, and loss_mask, the code points [start, end) of it that are learned.

    Turns come in the order of turn, ties by role and text, a null turn first; a null role or text counts as empty. Rows
    with a null conv_id are one conversation. Repeated rows are repeated turns. A conversation is one row of the result, so
    it takes the memory that its text takes. Other columns are ignored, whatever their names. An empty table gives none.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    def span(x: str) -> Column:
        size, before = F.length(x), F.coalesce(F.sum(F.length(x)).over(earlier), F.lit(0))
        head = F.length(F.regexp_extract(x, f"^(?s).*?{_quoted(TEXT)}", 0))
        return F.when(F.col("role") == LEARNED, F.struct((before + head).alias("start"), (before + size - len(END)).alias("end")))

    placed = rendered(rows).select("conv_id", F.row_number().over(order).alias("nth"), F.struct("role", "text").alias("source"), "rendered", "escaped", span("rendered").alias("span"), span("escaped").alias("escaped_span"))
    held = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "source", "rendered", "escaped", "span", "escaped_span"))).alias("turns"))
    each = lambda name: F.transform("turns", lambda t: t[name])
    spans = lambda name: F.filter(each(name), lambda s: s.isNotNull())
    made = held.select("conv_id", "turns", F.array_join(each("rendered"), "").alias("plain")).withColumn("same", parse(F.col("plain")) == each("source"))
    escaped = F.array_join(each("escaped"), "")
    checked = F.when(parse(escaped) == each("source"), escaped).otherwise(F.raise_error(F.lit("a conversation can't be read back from its rendering")).cast("string"))
    return made.select("conv_id", F.when(F.col("same"), F.col("plain")).otherwise(checked).alias("formatted"), F.when(F.col("same"), spans("span")).otherwise(spans("escaped_span")).alias("loss_mask"))


def report(made: DataFrame) -> DataFrame:
    """What formatted says, read back from it by the parser; the learned text is what loss_mask covers."""
    read = made.select("conv_id", "formatted", "loss_mask", parse(F.col("formatted")).alias("back"))
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report() of all conversations and of one that holds another template's control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).alias("conv_id"), F.inline(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", LEARNED))))))
    return report(conversations(rows.unionByName(extra)))


def _sql() -> str:
    """The same rows by plain string functions: rendering, escaping where a turn doesn't survive, and digests of the source."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    undo = lambda x: f"replace(replace({x}, '<~1', '<|'), '~0', '~')"
    do = lambda x: f"replace(replace({x}, '~', '~0'), '<|', '<~1')"
    marks = len(TURN) + len(TEXT) + len(END)
    return f"""
WITH source AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
kept AS (
  SELECT *, {undo("role")} = role AND {undo("text")} = text AND NOT contains(text, {lit(END)}) AND NOT contains(role, {lit(END)})
    AND NOT contains(role, {lit(TEXT)}) AS plain FROM source)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum({marks} + CASE WHEN plain THEN length(role) + length(text) ELSE length({do("role")}) + length({do("text")}) END) AS BIGINT) AS formatted_chars
FROM kept GROUP BY conv_id"""


SQL = _sql()

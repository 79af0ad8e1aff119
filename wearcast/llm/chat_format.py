"""Chat formatting: turns of typed content parts become one string per conversation.

Each turn is `<|turn|>role<|says|>content<|end|>`.  A visitor flattens the parts of a
turn in order: text parts stand as escaped text, image, audio and document parts as
the placeholder `<|image|>`, `<|audio|>` or `<|document|>` (any other kind:
`<|attachment|>`), with `<|part|>` between parts.  For each placeholder the visitor
records its turn, part, kind, reference and the tokens it expands to:
  image     ceil(width / PATCH) * ceil(height / PATCH)
  audio     ceil(seconds * AUDIO_RATE)
  document  pages * PAGE_TOKENS
(at least one; missing measures count as 0; other kinds one).

Escaping is reversible and leaves no control string in a text: a backslash is
doubled, and a backslash is put behind the first character of every control string
(CONTROL).  Back: of a backslash and a backslash behind it, the first goes.

The loss mask is the content of assistant turns, as spans of code points of the
formatted string.  `read_back` takes turns, texts and masked text from the string.

Turns stand by turn number (null first); ties by role, then content.  Null roles and
texts are empty; a null or empty array of parts is empty content; null parts are left
out.  Rows without conv_id are conversations of one turn each.  Repeated rows are
turns of their own; other columns are not read; an empty table gives an empty result.
A conversation is one string, so its turns meet in one group; the turns are
formatted before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END, PART = "<|turn|>", "<|says|>", "<|end|>", "<|part|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"   # fixed values: begins of control strings
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512
LEARNED = "assistant"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"))).cast("array<struct<kind:string,text:string>>")


def _field(part: Column, name: str, names: list[str], kind: str) -> Column:
    return F.coalesce(part[name].cast(kind), F.lit(0).cast(kind)) if name in names else F.lit(0).cast(kind)


def _tokens(part: Column, names: list[str]) -> Column:
    side = lambda c: F.ceil(_field(part, c, names, "long") / PATCH)
    made = F.when(part["kind"] == "image", side("width") * side("height")) \
            .when(part["kind"] == "audio", F.ceil(_field(part, "seconds", names, "double") * AUDIO_RATE)) \
            .when(part["kind"] == "document", _field(part, "pages", names, "long") * PAGE_TOKENS).otherwise(F.lit(0))
    return F.greatest(made.cast("long"), F.lit(1).cast("long"))


def visit(parts: Column, names: list[str]) -> tuple[Column, Column]:
    """(content, attachments) of a turn's parts, whose struct has the fields `names`."""
    mark = F.lit(OTHER)
    whole = F.filter(F.coalesce(parts, F.array().cast(f"array<struct<{','.join(f'{n}:{t}' for n, t in _types(names))}>>")), lambda p: p.isNotNull())
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"

    def placeholder(p):
        out = mark
        for kind, m in PLACEHOLDERS.items():
            out = F.when(p["kind"] == kind, F.lit(m)).otherwise(out)
        return out
    content = F.array_join(F.transform(whole, lambda p: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p))), PART)
    numbered = F.transform(whole, lambda p, i: F.struct(i.alias("part"), p.alias("p")))
    records = F.transform(F.filter(numbered, lambda x: ~is_text(x["p"])), lambda x: F.struct(
        x["part"].alias("part"), x["p"]["kind"].alias("kind"), (x["p"]["ref"] if "ref" in names else F.lit(None).cast("string")).alias("ref"),
        _tokens(x["p"], names).alias("tokens")))
    return content, records


def _types(names: list[str]) -> list[tuple[str, str]]:
    known = dict(f.split(":") for f in PARTS[len("array<struct<"):-2].split(","))
    return [(n, known[n]) for n in names]


def format_chat(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (start, end, loss_start, loss_end: code points, loss
    -1 where a turn is not learned) and attachments (turn, part, kind, ref, tokens) of
    each conversation of messages(conv_id, turn, role, parts); the struct of a part
    holds `kind`, `text` and any of the other fields of PARTS."""
    names = [f.name for f in messages.schema["parts"].dataType.elementType.fields if f.name in dict(_types(["kind", "text", "ref", "width", "height", "seconds", "pages"]))]
    parts = F.transform("parts", lambda p: F.when(p.isNotNull(), F.struct(*[p[n].cast(t).alias(n) for n, t in _types(names)])))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    content, records = visit(F.col("parts"), names)
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    rows = rows.select("conv_id", "turn", "role", content.alias("content"), records.alias("records"), head.alias("head"))
    rows = rows.withColumns({"piece": F.concat("head", "content", F.lit(END)), "learned": F.col("role") == LEARNED})
    rows = rows.withColumns({"size": F.length("piece").cast("long"), "before": F.length("head").cast("long")})
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    many = rows.where("conv_id is not null").withColumns({
        "place": F.row_number().over(ordered), "end": F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))})
    alone = rows.where("conv_id is null").withColumns({"place": F.lit(1), "end": F.col("size")})

    def turn() -> Column:
        start = F.col("end") - F.col("size")
        return F.struct(F.col("place"), F.col("piece"), start.alias("start"), F.col("end"),
                        F.when(F.col("learned"), start + F.col("before")).otherwise(F.lit(-1).cast("long")).alias("loss_start"),
                        F.when(F.col("learned"), F.col("end") - len(END)).otherwise(F.lit(-1).cast("long")).alias("loss_end"),
                        F.col("records"))
    whole = many.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn())).alias("t"))
    whole = whole.unionByName(alone.select("conv_id", F.array(turn()).alias("t")))
    return whole.select(
        "conv_id", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(t["start"], t["end"], t["loss_start"], t["loss_end"])).alias("turns"),
        F.flatten(F.transform("t", lambda t: F.transform(t["records"], lambda r: F.struct(
            (t["place"] - 1).alias("turn"), r["part"], r["kind"], r["ref"], r["tokens"])))).alias("attachments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The columns of `format_chat` and, from the string alone, `said` (role, text per
    turn; placeholders as they stand, one space between parts left out), and from string
    and mask `learned`, the unescaped text under the mask, turn by turn."""
    body = lambda piece: F.split(piece, F.lit(r"<\|says\|>"), 2)
    pieces = F.split("formatted", r"(?=<\|turn\|>)")
    plain = lambda text: unescape(F.replace(text, F.lit(PART), F.lit("")))
    said = F.transform("pieces", lambda p: F.struct(
        unescape(F.substring(body(p)[0], F.lit(len(TURN) + 1), F.length(p))).alias("role"),
        plain(F.replace(body(p)[1], F.lit(END), F.lit(""))).alias("text")))
    learned = F.filter(F.zip_with("pieces", "turns", lambda p, t: F.when(t["loss_start"] >= 0, plain(F.substring(
        p, (t["loss_start"] - t["start"] + 1).cast("int"), (t["loss_end"] - t["loss_start"]).cast("int"))))), lambda x: x.isNotNull())
    cols = [F.col(c) for c in formatted.columns]
    return formatted.withColumn("pieces", pieces).select(*cols, said.alias("said"), learned.alias("learned"))


def digest(read: DataFrame) -> DataFrame:
    """The contract's columns from what was read back."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    turns = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return read.select("conv_id", F.size("said").cast("long").alias("n_turns"), sha(turns).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def sql_rows(rows: list[tuple[int, int, str, str]]) -> str:
    """Rows (conv_id, turn, role, text without quotes and backslashes) for VALUES."""
    return ", ".join(f"(CAST({c} AS BIGINT), CAST({t} AS BIGINT), '{r}', '{x}')" for c, t, r, x in rows)


def oracle_sql(planted: list[tuple[int, int, str, str]]) -> str:
    """DuckDB SQL for the digests of `conversations` and the planted rows."""
    more = sql_rows(planted)
    grown = lambda c: f"(length({c}) + length(regexp_replace({c}, '[^\\\\]', '', 'g')) + len(regexp_extract_all({c}, '<\\||</?s>|<</?SYS>>|\\[/?INST\\]')))"
    return f"""
    WITH told AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own
        FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {more}) v(conv_id, turn, role, text)))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
           CAST(sum({len(TURN) + len(SAYS) + len(END)} + {grown('role')} + {grown('text')}) AS BIGINT) AS formatted_chars
    FROM told GROUP BY conv_id, own"""

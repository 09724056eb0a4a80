"""Chat formatting by quotation linking (DataFrame operations only).

Lines that begin with one or more `>` are quoted, as deep as they have marks;
neighbouring lines of one depth form a passage. What is left is the message's
own text. Own texts, their paragraphs and lines are normalised (lower case, one
blank between words) and hashed; a quoted passage with the same hash links to
the earliest message of its conversation that holds it as its own. A passage of
several lines without such a unit links to the earliest message that holds these
lines one after another, blank lines aside: own texts are hashed once more in
windows of as many lines as such passages of their conversation have. A message
answers the latest message that it quotes directly (else at any depth), else the
latest earlier one of its conversation, however many turns lie between. Depth and
thread come from pointer doubling over these answers.

Originals are minima by (conversation, hash), summed up before the shuffle, so a
line that is everywhere costs one row; no conversation is gathered in one task.

Null, empty, repeated: a null text is empty; a null turn answers nothing; rows
without conversation form one of their own; rows that share conversation and
turn are one node of the reply tree and are each returned; an empty table gives
an empty result. Further columns are carried along; those named like the added
ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

MARKS = r"^([ \t]*>)+"
CREDIT = r"(?i)\bwrote:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def own_text(text: Column) -> Column:
    """The text without quoted lines and without the line that credits the quote after it."""
    lines = F.split(text, "\n", -1)
    keep = lambda x, i: (quote_level(x) == 0) & ~(x.rlike(CREDIT) & (quote_level(F.coalesce(F.try_element_at(lines, i + 2), F.lit(""))) > 0))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?m)^[ \t]*>"), F.trim(F.array_join(F.filter(lines, keep), "\n"), F.lit(" \t\r\n"))).otherwise(F.coalesce(text, F.lit("")))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, text) of quoted passages; messages: conv_id, turn, text."""
    quoted = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", "text").distinct()
    lines = quoted.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("level", quote_level(F.col("line"))).where("level > 0")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("conv_id", "turn", "t", "level").orderBy("pos"))  # one text
    lines = lines.withColumn("run", run).withColumn("line", F.regexp_replace("line", MARKS + r"[ \t]?", ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("conv_id", "turn", "t", "level", "run").agg(text.alias("text")).select("conv_id", "turn", "level", "text")


def full_lines(text: Column) -> Column:
    """Normalised lines without blank ones."""
    return F.filter(F.transform(F.split(text, "\n", -1), normalised), lambda x: F.length(x) > 0)


def line_windows(own: DataFrame, part: DataFrame) -> DataFrame:
    """(c, wh, source): earliest turn of the passages `part` (pc, h, m lines) among runs of m lines of own texts (conv_id, turn, own)."""
    sizes = part.groupBy(F.col("pc").alias("c")).agg(F.collect_set("m").alias("sizes"))
    lines = own.select("conv_id", "turn", full_lines(F.col("own")).alias("lines")).where(F.size("lines") > 1)
    runs = lambda m: F.transform(F.sequence(F.lit(1), F.size("lines") - m + 1), lambda i: F.md5(F.array_join(F.slice("lines", i, m), " ").cast("binary")))
    hashes = F.flatten(F.transform(F.filter("sizes", lambda m: m <= F.size("lines")), runs))
    window = lines.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).select("c", "turn", F.explode(F.array_distinct(hashes)).alias("wh"))
    return window.groupBy("c", "wh").agg(F.min("turn").alias("source"))


def earlier(nodes: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn) with `before`, the latest smaller turn of the conversation.

    By runs of 1024 turns, then of 1024 runs and so on, so that no window holds more than 1024 rows.
    """
    nodes = stored(nodes, "chat-turns")
    lo, hi = nodes.agg(F.coalesce(F.min("turn"), F.lit(0)), F.coalesce(F.max("turn"), F.lit(0))).first()
    lag = lambda c, of, by: F.lag(c).over(Window.partitionBy("conv_id", of).orderBy(by))
    run = lambda c, k: F.lit(0) if (hi >> k) - (lo >> k) < 1024 else F.shiftright(c, 10)
    out, shift = nodes.withColumn("run", run("turn", 0)).withColumn("before", lag("turn", "run", "turn")).drop("run"), 0
    while (hi >> shift) - (lo >> shift) >= 1024:
        shift += 10
        runs = nodes.groupBy("conv_id", F.shiftright("turn", shift).alias("g")).agg(F.max("turn").alias("last")).withColumn("run", run("g", shift))
        runs = runs.select(F.col("conv_id").alias("rc"), "g", lag("last", "run", "g").alias("prev"))
        out = out.join(runs, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.shiftright("turn", shift) == F.col("g")), "left")
        out = stored(out.select("conv_id", "turn", F.coalesce("before", "prev").alias("before")), "chat-turns")
    return out


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """messages, the text without quotes, with reply_to, n_quotes, n_linked, depth (0 at a thread's start) and thread."""
    messages = messages.drop("reply_to", "n_quotes", "n_linked", "depth", "thread", "_c", "_n")
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = m.select("conv_id", "turn", own_text(F.col("text")).alias("own"))
    units = F.flatten(F.array(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n")))
    unit = own.where(F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(F.array_distinct(F.transform(units, lambda x: F.md5(normalised(x).cast("binary"))))).alias("h"))
    source = unit.groupBy(F.col("conv_id").alias("c"), "h").agg(F.min("turn").alias("source"))
    quotes = passages(m).withColumn("h", F.md5(normalised(F.col("text")).cast("binary"))).where(F.length(normalised(F.col("text"))) > 0).withColumn("m", F.size(full_lines(F.col("text")))).drop("text")
    source = source.withColumnRenamed("h", "_h")
    quotes = quotes.join(source, quotes["conv_id"].eqNullSafe(source["c"]) & (quotes["h"] == source["_h"]) & (F.col("source") < F.col("turn")), "left")
    quotes = stored(quotes.drop("c", "_h").select("conv_id", "turn", "level", "h", "m", "source"), "chat-quotes")
    part = quotes.where("source IS NULL AND m > 1").select(F.col("conv_id").alias("pc"), "h", "m").distinct()
    if not part.isEmpty():
        source = line_windows(own.where(F.col("turn").isNotNull()), part)
        quotes = quotes.withColumnRenamed("source", "unit").join(source, F.col("unit").isNull() & quotes["conv_id"].eqNullSafe(source["c"]) & (quotes["h"] == source["wh"]) & (F.col("source") < F.col("turn")), "left")
        quotes = quotes.select("conv_id", "turn", "level", F.coalesce("unit", "source").alias("source"))
    said = quotes.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("n")).agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), F.coalesce(F.max(F.when(F.col("level") == 1, F.col("source"))), F.max("source")).alias("quoted")
    )
    nodes = earlier(m.where(F.col("turn").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn")).distinct())
    nodes = nodes.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("n")), "left")
    reply = F.coalesce("quoted", "before")
    nodes = stored(nodes.select("conv_id", "turn", reply.alias("reply_to"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "chat-nodes")

    n = nodes.count()
    path = nodes.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("up"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("reply_to").isNull().alias("done"))
    while True:  # paths that have reached their start take no part in further rounds
        step = path.select(F.col("conv_id").alias("c"), F.col("turn").alias("n"), F.col("up").alias("up2"), F.col("steps").alias("more"), F.col("done").alias("end"))
        moved = path.where("NOT done").join(step, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n")))
        moved = moved.select("conv_id", "turn", F.col("up2").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("done"))
        path = stored(path.where("done").unionByName(moved), "chat-paths", n)
        if path.where("NOT done").isEmpty():
            break
    tree = path.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_n"), F.col("steps").alias("depth"), F.col("up").alias("thread"))
    facts = nodes.select(F.col("conv_id").alias("_fc"), F.col("turn").alias("_fn"), "reply_to", "n_quotes", "n_linked")
    tree = tree.join(facts, F.col("_c").eqNullSafe(F.col("_fc")) & (F.col("_n") == F.col("_fn"))).drop("_fc", "_fn")
    out = messages.withColumn(text_col, own_text(F.col(text_col)))
    out = out.join(tree, F.col(conv_col).eqNullSafe(F.col("_c")) & (F.col(turn_col) == F.col("_n")), "left").drop("_c", "_n")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_quotes", "n_linked", "depth")})


def conversations(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = 1000) -> DataFrame:
    """One row for each conversation, thread and part of `part_turns` turns: messages in reply order, quotes removed.

    Answers come after what they answer, as links only lead back; parts keep rows bounded. Messages without a turn
    have no place in a conversation: each is a row of its own.
    """
    message = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), "reply_to", "depth", F.col(text_col).alias("text"), "n_quotes", "n_linked")
    part = F.floor(F.col(turn_col) / part_turns).alias("part")
    alone = F.when(F.col(turn_col).isNull(), F.monotonically_increasing_id()).alias("_alone")
    keyed = linked.select(F.col(conv_col).alias("conv_id"), "thread", part, alone, message.alias("_m"))
    return keyed.groupBy("conv_id", "thread", "part", "_alone").agg(F.array_sort(F.collect_list("_m")).alias("messages")).drop("_alone")


def messages_in_order(convs: DataFrame) -> DataFrame:
    """The messages of conversations(), each with its position in its part."""
    return convs.select("conv_id", "thread", "part", F.posexplode("messages").alias("position", "_m")).select("conv_id", "thread", "part", F.col("position").cast("long").alias("position"), "_m.*")


ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, turn, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM (SELECT DISTINCT conv_id, turn, text FROM m)),
v AS (SELECT *, len(regexp_extract(line, '^([ \t]*>)+')) - len(replace(regexp_extract(line, '^([ \t]*>)+'), '>', '')) AS level FROM l),
o AS (SELECT conv_id, turn, text, CASE WHEN max(level) > 0 THEN trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT (regexp_matches(line, '(?i)\bwrote:[ \t]*$') AND nxt > 0)), ''), E' \t\r\n') ELSE text END AS own
  FROM (SELECT *, coalesce(lead(level) OVER (PARTITION BY conv_id, turn, text ORDER BY pos), 0) AS nxt FROM v) GROUP BY conv_id, turn, text),
u AS (SELECT conv_id, turn, trim(regexp_replace(lower(unnest(list_concat([own], list_concat(string_split_regex(own, '\n[ \t]*\n'), string_split(own, chr(10)))))), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM o WHERE turn IS NOT NULL),
s AS (SELECT conv_id, h, min(turn) AS source FROM u GROUP BY ALL),
p AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(string_agg(regexp_replace(line, '^([ \t]*>)+[ \t]?', ''), chr(10) ORDER BY pos)), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
    count(*) FILTER (regexp_matches(regexp_replace(line, '^([ \t]*>)+[ \t]?', ''), '[^\x20\x09-\x0D]')) AS m
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, text, level ORDER BY pos) AS run FROM v WHERE level > 0) GROUP BY conv_id, turn, text, level, run),
pu AS (SELECT p.*, source AS whole FROM p LEFT JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.h = s.h AND source < p.turn WHERE p.h <> ''),
ol AS (SELECT conv_id, turn, list_filter(list_transform(string_split(own, chr(10)), lambda x: trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM o WHERE turn IS NOT NULL),
wl AS (SELECT conv_id, h, min(turn) AS source FROM (SELECT ol.conv_id, ol.turn, unnest(list_transform(range(1, len(ls) - m + 2), lambda i: array_to_string(list_slice(ls, i, i + m - 1), ' '))) AS h
  FROM ol JOIN (SELECT DISTINCT conv_id AS pc, m FROM pu WHERE whole IS NULL AND m > 1) ON conv_id IS NOT DISTINCT FROM pc AND m <= len(ls)) GROUP BY ALL),
pl AS (SELECT pu.*, coalesce(whole, wl.source) AS source FROM pu LEFT JOIN wl ON whole IS NULL AND m > 1 AND pu.conv_id IS NOT DISTINCT FROM wl.conv_id AND pu.h = wl.h AND wl.source < pu.turn),
q AS (SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked, coalesce(max(CASE WHEN level = 1 THEN source END), max(source)) AS quoted FROM pl GROUP BY ALL),
n AS (SELECT a.conv_id, a.turn, coalesce(quoted, a.before) AS reply_to, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked
  FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM m WHERE turn IS NOT NULL)) a
  LEFT JOIN q ON a.conv_id IS NOT DISTINCT FROM q.conv_id AND a.turn = q.turn),
t AS (SELECT conv_id, turn, 0 AS depth, turn AS thread FROM n WHERE reply_to IS NULL
  UNION ALL SELECT n.conv_id, n.turn, t.depth + 1, t.thread FROM n JOIN t ON n.conv_id IS NOT DISTINCT FROM t.conv_id AND n.reply_to = t.turn)
, f AS (SELECT m.conv_id, m.turn, m.role, o.own AS text, n.reply_to, CAST(coalesce(n.n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n.n_linked, 0) AS BIGINT) AS n_linked, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth, t.thread, CAST(floor(m.turn / 1000.0) AS BIGINT) AS part
FROM m JOIN o ON m.conv_id IS NOT DISTINCT FROM o.conv_id AND m.turn IS NOT DISTINCT FROM o.turn AND m.text = o.text
LEFT JOIN n ON m.conv_id IS NOT DISTINCT FROM n.conv_id AND m.turn = n.turn LEFT JOIN t ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.turn = t.turn)
SELECT conv_id, thread, part, turn, role, text, reply_to, n_quotes, n_linked, depth,
  CASE WHEN turn IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY conv_id, thread, part ORDER BY turn NULLS FIRST, role NULLS FIRST, reply_to NULLS FIRST, depth, text NULLS FIRST) - 1 END AS position
FROM f
"""

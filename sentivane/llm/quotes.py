"""Chat formatting by quotation linking, with DataFrame functions only.

A line that begins with `>` marks (blanks between them allowed) is quoted at as many levels as it has
marks.  Runs of quoted lines of one level are passages; a blank line ends a passage.  Passages and
the paragraphs and lines of what messages say themselves are normalised (lower case, blanks
squeezed) and hashed.  A passage of any level links its message to the first message of the
conversation that said it itself, if that one came earlier: a whole paragraph, else one of its lines.
The least nested passages go first: a deeper quote is what the quoted message quoted, so its author
is the parent only where no passage of a lower level is found.  Of several linked messages at that
level the latest is the parent.

Messages are returned without their quotes, in reply order: `reply_path` holds the turns from the
first message of the thread down to the message itself, and ordering by (conv_id, reply_path) is the
conversation read reply by reply.  Order is a column and not a list per conversation, so that a very
long conversation stays many rows.

Null texts count as empty, a null role stays null.  Rows without conversation or turn have no place
in a conversation: their parent is null and their path is empty.  Several rows of one turn are kept
and share the links that any of them has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivane.session import stage

MARKS = r"^[ \t]*(>[ \t]*)+"


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n]+", " "))


def _levels(text: Column) -> Column:
    """array<struct(level, line)>: every line without its marks and how many it had."""
    return F.transform(F.split(text, "\n"), lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(line, MARKS, "").alias("line")))


def _runs(lines: Column) -> Column:
    """array<struct(level, said)>: runs of lines of one level between blank lines, joined by \\n.

    Lines are joined with a sign that no line holds in front of a change of level or a blank line,
    and split there: work in proportion to the text.
    """
    tagged = F.transform(lines, lambda x: F.when(F.trim(x["line"]) == "", F.lit("\n")).otherwise(
        F.concat(F.lit("\r"), x["level"].cast("string"), F.lit(":"), x["line"])))
    before = F.concat(F.array(F.lit("\n")), F.slice(tagged, 1, F.greatest(F.size(tagged) - 1,
                                                                         F.lit(0))))
    level_of = lambda s: F.regexp_extract(s, "^\r([0-9]+):", 1)
    parts = F.zip_with(tagged, before, lambda now, last: F.when(now == "\n", F.lit("\n\n")).when(
        level_of(now) == level_of(last), F.concat(F.lit("\n"), F.regexp_replace(
            now, "^\r[0-9]+:", ""))).otherwise(F.concat(F.lit("\n\n"), now)))
    runs = F.filter(F.split(F.array_join(parts, ""), "\n\n+"), lambda x: x != "")
    return F.transform(runs, lambda x: F.struct(
        level_of(x).cast("int").alias("level"),
        F.regexp_replace(x, "^\r[0-9]+:", "").alias("said")))


def _hashes(said: Column) -> Column:
    """Hashes of a run as a whole and of each of its lines."""
    lines = F.filter(F.transform(F.split(said, "\n"), normal), lambda x: x != "")
    return F.array_distinct(F.transform(
        F.concat(F.array(normal(said)), lines), lambda x: F.xxhash64(x)))


def parse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """Messages with their own words, the runs they consist of and their quote levels."""
    clear = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r"), F.lit(""))
    return (
        turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                     F.col(role).alias("role"), _levels(clear).alias("lines"))
        .select(
            "conv_id", "turn", "role",
            F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0),
                                     lambda x: x["line"]), "\n").alias("body"),
            F.array_max(F.transform("lines", lambda x: x["level"])).alias("max_level"),
            F.exists("lines", lambda x: x["level"] > 0).alias("quotes"),
            _runs(F.col("lines")).alias("runs"))
    )


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): the latest of the messages quoted at the lowest level that links.

    Only conversations with quotes take part.  The first message that said something is a grouped
    minimum, so a phrase that everybody repeats is one row on that side of the join.
    """
    there = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = there.filter("quotes").select(
        "conv_id", "turn", F.posexplode(F.filter("runs", lambda r: r["level"] > 0))
        .alias("passage", "run")).select(
        "conv_id", "turn", "passage", "run.level", F.posexplode(_hashes(F.col("run.said")))
        .alias("part", "hash"))
    asked = quoted.select("conv_id", "hash").distinct()
    said = there.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select(
        "conv_id", "turn", F.explode(F.array_distinct(F.flatten(F.transform(
            F.filter("runs", lambda r: r["level"] == 0), lambda r: _hashes(r["said"])))))
        .alias("hash"))
    first = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    found = quoted.join(first, ["conv_id", "hash"]).filter("origin < turn")
    # a passage as a whole (part 0) goes before its lines
    best = found.groupBy("conv_id", "turn", "passage", "level").agg(
        F.max(F.struct((F.col("part") == 0).alias("whole"), "origin")).alias("best"))
    near = F.max(F.struct((-F.col("level")).alias("near"), "best.origin"))
    return best.groupBy("conv_id", "turn").agg(near["origin"].alias("parent"))


def paths(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, above): the turns from the thread's first message down to the parent.

    Pointers double every round: after k rounds a path is known 2^k messages up.
    """
    now = stage(parents.select("conv_id", "turn", F.col("parent").alias("up"),
                               F.array("parent").alias("above")), "paths")
    while not now.filter("up IS NOT NULL").isEmpty():
        hop = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"),
                         F.col("above").alias("more"))
        now = stage(now.join(hop, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.col("next").alias("up"),
            F.concat(F.coalesce("more", F.array().cast("array<bigint>")), "above")
            .alias("above")), "paths")
    return now.select("conv_id", "turn", "above")


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, body, max_level, parent_turn, reply_path) of every message."""
    messages = parse(turns, conv, turn, role, text)
    linked = links(messages).select("conv_id", "turn", F.col("parent").cast("bigint"))
    above = paths(linked)
    shown = messages.select(
        "conv_id", "turn", "role", F.btrim("body", F.lit("\n\t ")).alias("body"), "max_level")
    return shown.join(above, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", F.col("max_level").cast("bigint").alias("max_level"),
        F.try_element_at("above", F.lit(-1)).alias("parent_turn"),
        F.when(F.col("conv_id").isNull() | F.col("turn").isNull(),
               F.array().cast("array<bigint>"))
        .otherwise(F.concat(F.coalesce("above", F.array().cast("array<bigint>")),
                            F.array(F.col("turn").cast("bigint")))).alias("reply_path"))


SQL = r"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, role, pos, x,
    length(regexp_replace(regexp_extract(x, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(x, '^[ \t]*(>[ \t]*)+', '') AS line
  FROM (SELECT conv_id, turn, role, unnest(string_split(t, chr(10))) AS x,
               generate_subscripts(string_split(t, chr(10)), 1) AS pos
        FROM (SELECT conv_id, turn, role, replace(coalesce(text, ''), chr(13), '') AS t
              FROM conversations))),
m AS (SELECT conv_id, turn, any_value(role) AS role, max(level) AS max_level,
        trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), ''),
             chr(10) || chr(9) || ' ') AS body
      FROM l GROUP BY conv_id, turn),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM (
        SELECT *, CASE WHEN trim(line) = '' OR lag(trim(line)) OVER w = ''
                         OR lag(level) OVER w IS DISTINCT FROM level THEN 1 ELSE 0 END AS new
        FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos))),
p AS (SELECT conv_id, turn, run, any_value(level) AS level,
        string_agg(line, chr(10) ORDER BY pos) AS said, list(line ORDER BY pos) AS lines
      FROM r WHERE trim(line) <> '' GROUP BY conv_id, turn, run),
h AS (SELECT conv_id, turn, run, level, TRUE AS whole, said AS s FROM p
      UNION ALL SELECT conv_id, turn, run, level, FALSE, unnest(lines) FROM p),
n AS (SELECT conv_id, turn, run, level, whole,
        trim(regexp_replace(lower(s), '[ \t\r\n]+', ' ', 'g')) AS s FROM h),
first AS (SELECT conv_id, s, min(turn) AS origin FROM n WHERE level = 0 AND s <> ''
          GROUP BY conv_id, s),
best AS (SELECT conv_id, turn, run, any_value(level) AS level, max((whole, origin)) AS b
         FROM n JOIN first USING (conv_id, s) WHERE level > 0 AND origin < turn
         GROUP BY conv_id, turn, run),
near AS (SELECT *, min(level) OVER (PARTITION BY conv_id, turn) AS lowest FROM best),
link AS (SELECT conv_id, turn, max(b[2]) AS parent FROM near WHERE level = lowest
         GROUP BY conv_id, turn),
up AS (SELECT conv_id, turn, parent, [turn] AS path FROM m LEFT JOIN link USING (conv_id, turn)
       UNION ALL
       SELECT up.conv_id, up.turn, link.parent, [up.parent] || up.path
       FROM up LEFT JOIN link ON link.conv_id = up.conv_id AND link.turn = up.parent
       WHERE up.parent IS NOT NULL)
SELECT conv_id, turn, role, body, max_level::BIGINT AS max_level,
  link.parent::BIGINT AS parent_turn, path AS reply_path
FROM m JOIN up USING (conv_id, turn) LEFT JOIN link USING (conv_id, turn)
WHERE up.parent IS NULL
"""

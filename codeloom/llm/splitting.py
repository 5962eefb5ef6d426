"""Items above a size limit cut into overlapping pieces at natural boundaries.

Sizes are UTF-8 bytes.  The text is read as one character per byte (Latin-1 of
its UTF-8 bytes), so the quantifiers of a regular expression count bytes and a
negated look-ahead for continuation bytes keeps characters whole.  One pattern
with bounded quantifiers takes the next cut: its alternatives, from strong to
weak, end after a blank line, before a line that starts a block, after a line,
a sentence or clause, a blank, and at last after any character, each consuming
as much as it can up to the limit.  Overlaps are look-back offsets into the
text before a piece, moved back to the start of a character.  All of it is
built-in SQL functions over one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.common import SPELLINGS

#: A cut at a natural boundary fills at least this share of a piece.
FILL = 0.5
#: The longest UTF-8 sequence less one: room to move an overlap back to a character.
SLACK = 3


def cut_pattern(room: Column) -> Column:
    """The pattern of the next cut, for ``room`` bytes (a column)."""
    low = F.greatest(F.lit(1), F.floor(room * FILL)).cast("string")
    high = room.cast("string")
    most = F.greatest(F.lit(1), room - 1).cast("string")
    most2 = F.greatest(F.lit(1), room - 2).cast("string")
    between = lambda a, b: F.concat(F.lit("[\\s\\S]{"), a, F.lit(","), b, F.lit("}"))
    return F.concat(
        F.lit("[\\s\\S]{1,"), high, F.lit("}\\z|"),
        between(low, most2), F.lit("(?:\\n\\n|\\n\\r\\n)|"),
        between(low, most), F.lit("\\n(?=[A-Za-z@#/}\"'<\\[])|"),
        between(low, most), F.lit("\\n|"),
        between(low, most), F.lit("(?<=[.!?;:,){}\\]])[ \\t]|"),
        between(low, most), F.lit("[ \\t]|"),
        between(low, most), F.lit("[;,){}\\]]|"),
        between(F.lit("1"), high), F.lit("(?![\\x80-\\xBF])|"),
        F.lit("[\\s\\S][\\x80-\\xBF]{0,3}"),
    )


def to_bytes(text: Column) -> Column:
    """One Latin-1 character per UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def to_text(latin: Column) -> Column:
    return F.decode(F.encode(latin, "ISO-8859-1"), "UTF-8")


def split(items: DataFrame, text: str, limit: str, overlap: str, keys: list[str]) -> DataFrame:
    """``*keys, piece, start_byte, repeated, text``: the pieces of every item above its limit, in order from 1.

    ``text`` names the string column, ``limit`` and ``overlap`` columns of sizes
    in bytes.  A piece is at most ``limit`` bytes; all but the first start with
    ``repeated`` bytes of the piece before: ``overlap``, or up to three more
    where it would cut a character (less if the piece before is shorter).
    Dropping these bytes and joining the pieces gives the item back.  Items
    within the limit, null or empty ones, and those without a limit give no row.
    An overlap that leaves no room for a character under the limit is an error.
    Repeated rows give repeated pieces; other columns are ignored.
    """
    b = items.select(
        *keys,
        to_bytes(F.col(text)).alias("_b"),
        F.col(limit).cast("int").alias("_limit"),
        F.greatest(F.coalesce(overlap, F.lit(0)), F.lit(0)).cast("int").alias("_overlap"),
    ).where(F.length("_b") > F.col("_limit"))
    room = F.col("_limit") - F.col("_overlap") - F.when(F.col("_overlap") > 0, SLACK).otherwise(0)
    none = F.raise_error(F.concat(F.lit("no room for a character under a limit of "), F.col("_limit"), F.lit(" with an overlap of "), F.col("_overlap")))
    b = b.withColumn("_room", F.when(room >= 4, room).otherwise(none.cast("int"))).withColumn("_pattern", cut_pattern(F.col("_room")))
    b = b.withColumn("_cores", F.expr("regexp_extract_all(_b, _pattern, 0)")).drop("_b")
    # What comes before each core: where it starts, and its last bytes, carried from core to core.
    b = b.withColumn(
        "_before",
        F.expr(
            f"""aggregate(_cores, named_struct('at', 0, 't', '', 'all', cast(array() as array<struct<at:int,t:string>>)),
            (a, x) -> named_struct('at', a.at + length(x), 't', right(concat(a.t, right(x, _overlap + {SLACK})), _overlap + {SLACK}),
            'all', array_append(a.all, named_struct('at', a.at, 't', a.t))), a -> a.all)"""
        ),
    )
    exploded = b.select(*keys, "_overlap", F.posexplode(F.arrays_zip("_before", "_cores")).alias("_i", "_p"))
    at, tail, core = F.col("_p._before.at"), F.col("_p._before.t"), F.col("_p._cores")
    back = F.least(F.col("_overlap"), at)
    # The look-back starts on a character: step over at most three continuation bytes.
    lead = lambda k: F.substring(tail, F.length(tail) - back + 1 - k, F.lit(1))
    inside = lambda k: lead(k).rlike("[\\x80-\\xBF]") & (at - back - k > 0)
    steps = F.when(back <= 0, 0).when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    sized = exploded.select(*keys, "_i", at.alias("_at"), tail.alias("_tail"), core.alias("_core"), (back + steps).alias("_back"))
    return sized.select(
        *keys,
        (F.col("_i") + 1).alias("piece"),
        (F.col("_at") - F.col("_back")).cast("bigint").alias("start_byte"),
        F.col("_back").cast("int").alias("repeated"),
        to_text(F.concat(F.when(F.col("_back") > 0, F.right("_tail", F.col("_back"))).otherwise(""), "_core")).alias("text"),
    )


def canonical(lang: Column, path: Column | None = None) -> Column:
    """The canonical name of a language column, in SQL."""
    spelled = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    low = F.lower(F.trim(lang))
    return F.coalesce(F.try_element_at(spelled, low), low)


def with_limits(nodes: DataFrame, limits: DataFrame, purpose: str = "source_piece") -> DataFrame:
    """Nodes with ``max_size`` and ``overlap_size`` of their language, in any spelling, or of the row without one.

    Of several rows of a language the least limit counts.  The table of limits
    is joined; a node without any limit has nulls.
    """
    rows = limits.where(F.col("purpose") == purpose).select(canonical(F.col("lang")).alias("_lang"), "max_size", "overlap_size")
    first = F.min(F.struct(F.col("max_size").cast("bigint").alias("max_size"), F.col("overlap_size").cast("bigint").alias("overlap_size")))
    own = rows.where(F.col("_lang").isNotNull()).groupBy("_lang").agg(first.alias("_own"))
    rest = rows.where(F.col("_lang").isNull()).agg(first.alias("_rest"))  # one row
    joined = nodes.withColumn("_lang", canonical(F.col("lang"))).join(own, "_lang", "left").join(F.broadcast(rest))
    limit = F.coalesce("_own", "_rest")
    return joined.withColumn("max_size", limit["max_size"]).withColumn("overlap_size", limit["overlap_size"]).drop("_lang", "_own", "_rest")


def source_pieces(nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """``node_id, piece, start_byte, repeated, text`` of FILE, FUNCTION and METHOD sources above their limit.

    A node delivered twice gives its pieces once, one delivered with several
    sources those of the greatest.
    """
    kept = nodes.where(F.col("kind").isin("FILE", "FUNCTION", "METHOD") & F.col("source").isNotNull() & F.col("id").isNotNull())
    sized = with_limits(kept.select(F.col("id").alias("node_id"), "lang", "source"), limits)
    over = sized.where(F.octet_length("source") > F.col("max_size")).groupBy("node_id", "max_size", "overlap_size").agg(F.max("source").alias("source"))
    return split(over, "source", "max_size", "overlap_size", ["node_id"])

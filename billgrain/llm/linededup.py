"""Lines that repeat, exactly or within a few edits, across all documents.

Segment-partition edit join: a line is cut into ``max_edits + 1`` segments, so a line within
``max_edits`` edits holds one of them unchanged, near its old place. Digests of the segments
are the index; longer lines probe it with the substrings that length and place allow. Lines
that meet at a digest are verified with a banded bit-parallel edit distance. Where many lines
meet at one digest (they share a segment, as lines made from a template do), they are first
told apart by what is left of them: for one edit by pieces of it, again and again, and at last
by the little that is unknown with up to ``max_edits`` characters deleted. Lines within the
threshold still meet, and no crowd of others.

Only digests and places are shuffled for all lines; texts move only for lines that met
another one. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billgrain.llm.common import stored, text_of

#: Lines that meet at one digest are paired directly up to this number; both ways are exact.
DIRECT = 16
#: Pieces into which the unknown rest of crowded lines is cut, and how often.
PIECES, LEVELS = 4, 3
#: Words of 64 bits in the filter that tells which lines' texts are needed: at most 2 MiB.
FILTER_WORDS = 1 << 18


def _keys(max_edits: int) -> str:
    """SQL for an array of ``(key, role, at, n)``: index segments (role 0) and probes (role 1) of ``line``."""
    parts, found = max_edits + 1, []
    for less in range(max_edits + 1):  # the other line is so much shorter
        size = f"(len - {less})"
        short = f"({parts} - {size} % {parts})"  # so many segments have the smaller length
        for i in range(parts):
            start = f"({i} * ({size} div {parts}) + greatest(0, {i} - {short}))"
            n = f"({size} div {parts} + if({i} >= {short}, 1, 0))"
            low, high = max(-i, less - (max_edits - i)), min(i, less + (max_edits - i))
            for shift in range(low, high + 1):
                role = 0 if less == 0 and shift == 0 else 1
                at = f"({start} + {shift})"
                found.append(f"named_struct('key', xxhash64({size}, {i}, substring(line, {at} + 1, {n})), 'role', {role}, 'at', {at}, 'n', {n}, 'fits', {at} >= 0 AND {at} + {n} <= len)")
    return f"filter(array({', '.join(found)}), k -> k.fits)"


def edit_distance(first: str, second: str, most: int) -> str:
    """SQL for the edit distance of two columns if it is at most ``most``, else something larger.

    Banded bit-parallel: a word holds the ``2 * most + 1`` cells of a column around the diagonal
    as vertical differences; each character of the shorter text moves it one column on.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    same = " | ".join(
        f"if(coalesce(get(p.a, i + {b - most}) = get(p.b, i), false), {1 << b}L, 0L)" for b in range(width)
    )
    step = f"""transform(array({same}), x ->
      transform(array(((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {full}L), d ->
      transform(array(named_struct('hp', (s.vn | ~(d | s.vp)) & {full}L, 'hn', d & s.vp)), h ->
        named_struct(
          'vp', (h.hn | ~(shiftright(d, 1) | h.hp)) & {full}L,
          'vn', shiftright(d, 1) & h.hp,
          'cost', s.cost + if(i < size(p.a) - {most},
              if((d & {1 << (width - 1)}L) = 0, 1, 0),
              if((h.hp & s.row) != 0, 1, 0) - if((h.hn & s.row) != 0, 1, 0)),
          'row', if(i < size(p.a) - {most}, s.row, shiftright(s.row, 1))))[0])[0])[0]"""
    top = f"least({most}, size(p.a))"  # the lowest cell of the first column inside the longer text
    start = f"named_struct('vp', {(full << most) & full}L, 'vn', 0L, 'cost', {top}, 'row', shiftleft(1L, {most} - 1 + {top}))"
    longer = f"if(char_length({first}) >= char_length({second}), {first}, {second})"
    shorter = f"if(char_length({first}) >= char_length({second}), {second}, {first})"
    walk = f"aggregate(if(size(p.b) > 0, sequence(0, size(p.b) - 1), array()), {start}, (s, i) -> {step}, s -> s.cost)"
    return (
        f"CASE WHEN {first} = {second} THEN 0 "
        f"WHEN {most} = 0 OR abs(char_length({first}) - char_length({second})) > {most} THEN {most + 1} "
        f"WHEN char_length({shorter}) = 0 THEN char_length({longer}) "
        f"ELSE transform(array(named_struct('a', split({longer}, ''), 'b', split({shorter}, ''))), p -> {walk})[0] END"
    )


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    text = text_of(text_col)
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("body"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(" \t\r"))).withColumn("len", F.char_length("line")).where(F.col("len") >= min_chars)
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _met(distinct: DataFrame) -> DataFrame:
    """``key, crowd, role, at, n, h1, h2``: the lines at each digest where two can be near."""
    rows = distinct.select("h1", "h2", F.explode("keys").alias("k")).select("h1", "h2", "k.key", "k.role", "k.at", "k.n")
    at_key = rows.groupBy("key").agg(F.sum(F.expr("1 - role")).alias("indexed"), F.count("*").alias("crowd"))
    at_key = at_key.where("indexed >= 1 AND crowd >= 2")
    return rows.join(at_key.select("key", "crowd"), "key")


def _crowded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("crowd", F.count("*").over(Window.partitionBy("key", "part")))


def _told_apart(rows: DataFrame) -> DataFrame:
    """Crowds cut by what is left of the lines: a single edit changes one of ``PIECES`` pieces of it.

    Lines meet again if all other pieces agree; a probe, longer by one character, has it in the
    piece that is left over. Only that piece is still unknown.
    """
    n = "(char_length(rest) - role)"
    start, end = f"(k * {n} div {PIECES})", f"((k + 1) * {n} div {PIECES})"
    left, right = f"substring(rest, 1, {start})", f"substring(rest, {end} + role + 1)"
    pieces = f"transform(sequence(0, {PIECES - 1}), k -> named_struct('part', xxhash64(part, {n}, k, {left}, {right}), 'rest', substring(rest, {start} + 1, {end} - {start} + role)))"
    same = "array(named_struct('part', part, 'rest', rest))"
    cut = _crowded(rows).withColumn("cut", F.explode(F.expr(f"if(crowd <= {DIRECT}, {same}, {pieces})")))
    return cut.select("key", "role", "h1", "h2", "line", "cut.part", "cut.rest")


def near_lines(docs: DataFrame, id_col: str, text_col: str, max_edits: int, min_chars: int, distinct: DataFrame) -> DataFrame:
    """Pairs ``a1, a2, b1, b2`` of digests of different lines within ``max_edits`` edits, each once."""
    met = stored(_met(distinct))
    lines = met.select("h1", "h2").distinct()
    word, bit = F.pmod("h1", F.lit(FILTER_WORDS)), F.pmod(F.shiftright("h1", 18), F.lit(64)).cast("int")
    needed = lines.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    texts = _occurrences(docs, id_col, text_col, min_chars).select("h1", "h2", "line", word.alias("word"), bit.alias("bit"))
    texts = texts.join(F.broadcast(needed), "word").where(F.getbit("bits", F.col("bit")) == 1)
    texts = texts.groupBy("h1", "h2").agg(F.first("line").alias("line"))
    met = met.join(texts, ["h1", "h2"])
    rows = met.select("key", "role", "h1", "h2", "line", F.lit(0).cast("long").alias("part"), F.expr("concat(substring(line, 1, at), substring(line, at + n + 1))").alias("rest"))
    for _ in range(LEVELS if max_edits == 1 else 0):
        rows = _told_apart(rows)
    fewer = "array(rest)"
    for _ in range(max_edits):
        fewer = f"array_union({fewer}, flatten(transform({fewer}, r -> transform(if(r = '', array(), sequence(1, char_length(r))), j -> concat(substring(r, 1, j - 1), substring(r, j + 1))))))"
    told = f"if(crowd <= {DIRECT}, array(part), array_distinct(transform({fewer}, r -> xxhash64(part, r))))"
    rows = _crowded(rows).select("key", "role", "h1", "h2", "line", F.explode(F.expr(told)).alias("part"))
    index, other = rows.where("role = 0"), rows
    a, b = index.alias("a"), other.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")))
    pairs = pairs.where("(a.h1, a.h2) != (b.h1, b.h2) AND (b.role = 1 OR (a.h1, a.h2) < (b.h1, b.h2))")
    near = pairs.where(F.expr(edit_distance("a.line", "b.line", max_edits)) <= max_edits)
    first = F.expr("least(struct(a.h1 AS h1, a.h2 AS h2), struct(b.h1 AS h1, b.h2 AS h2))")
    second = F.expr("greatest(struct(a.h1 AS h1, a.h2 AS h2), struct(b.h1 AS h1, b.h2 AS h2))")
    near = near.select(first.alias("x"), second.alias("y")).distinct()
    return near.select(F.col("x.h1").alias("a1"), F.col("x.h2").alias("a2"), F.col("y.h1").alias("b1"), F.col("y.h2").alias("b2"))


def line_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 20, short: bool = False
) -> DataFrame:
    """Each line of at least ``min_chars`` characters: ``id, body, line_no, first_id, first_line, times, links, kept``.

    Lines are compared without blanks, tabs and carriage returns at their ends and ordered by
    (id, digest of the text, number), null ids first. ``first_id, first_line``: where the line
    stands first; ``times``: how often; ``links``: the number of other texts of lines within
    ``max_edits`` edits. A line is kept where it stands first, unless a line within the
    threshold stands earlier. Rows equal in id and text share their places, so they keep the
    same lines; two texts are taken for one if two 64-bit digests agree. Null and empty texts
    have no lines. ``short`` adds the shorter lines that are not empty, which repeat only
    exactly; without it they are not looked at. Nor are other columns.
    """
    occurrences = _occurrences(docs, id_col, text_col, 1 if short else min_chars)
    keys = f"filter({_keys(max_edits)}, k -> len >= {min_chars})"
    place = F.struct("id", "body", "no")
    distinct = stored(
        occurrences.withColumn("keys", F.expr(f"transform({keys if short else _keys(max_edits)}, k -> named_struct('key', k.key, 'role', k.role, 'at', k.at, 'n', k.n))"))
        .groupBy("h1", "h2")
        .agg(F.min(place).alias("place"), F.count("*").alias("times"), F.first("keys").alias("keys"))
    )
    near = stored(near_lines(docs, id_col, text_col, max_edits, min_chars, distinct))
    ends = near.selectExpr("a1 AS h1", "a2 AS h2", "b1 AS o1", "b2 AS o2").unionByName(near.selectExpr("b1 AS h1", "b2 AS h2", "a1 AS o1", "a2 AS o2"))
    places = distinct.select("h1", "h2", "place")
    ends = ends.join(places, ["h1", "h2"]).join(places.selectExpr("h1 AS o1", "h2 AS o2", "place AS other"), ["o1", "o2"])
    linked = ends.groupBy("h1", "h2").agg(F.count("*").alias("links"), F.max(F.col("other") < F.col("place")).alias("later"))
    facts = distinct.select("h1", "h2", "place", "times").join(linked, ["h1", "h2"], "left")
    return (
        occurrences.select("h1", "h2", "id", "body", "no")
        .join(facts, ["h1", "h2"])
        .select(
            F.col("id").alias(id_col),
            "body",
            F.col("no").alias("line_no"),
            F.col("place.id").alias("first_id"),
            F.col("place.no").alias("first_line"),
            "times",
            F.coalesce("links", F.lit(0)).alias("links"),
            (F.col("place").eqNullSafe(place) & ~F.coalesce("later", F.lit(False))).alias("kept"),
        )
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 20, short: bool = False) -> DataFrame:
    """The documents without the lines that ``line_classes`` does not keep; all columns and rows stay.

    A text of which nothing is left becomes empty, a null text stays null.
    """
    gone = line_classes(docs, id_col, text_col, max_edits, min_chars, short).where("NOT kept")
    gone = gone.groupBy(F.col(id_col).alias("_gone_id"), F.col("body").alias("_gone_body")).agg(F.collect_set("line_no").alias("_gone"))
    match = docs[id_col].eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text_of(text_col)) == F.col("_gone_body"))
    left = F.filter(F.split(text_col, "\n"), lambda line, no: ~F.array_contains("_gone", no))
    cleaned = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return docs.join(gone, match, "left").select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns])

"""Licence scan: entire texts looked up by digest among known licences and notices.

A text is brought to one form: lower case, copyright lines gone, equivalent spellings made
one, punctuation and white space reduced to single blanks. Its digest is joined with those of
the known texts. Looked up are the whole document, each of its lines, and its blocks of lines
between blank ones: a known text of several blocks is found where all of them follow each
other, whichever way their lines are wrapped.
"""

from __future__ import annotations

import re
import textwrap
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrain.llm.common import text_of

#: Usual short notices, as their licences tell users to write them.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Spellings that mean the same, and the one that stays.
SPELLINGS = (
    ("licence", "license"),
    ("licensed", "license"),
    ("licenced", "license"),
    ("released", "license"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("http", "https"),
    ("v", "version"),
)
#: A line that says who holds the rights since when: the word or sign, and a year or the sign after the word.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright[ \t]*(?:\(c\)|©)|(?:copyright|\(c\))[ \t]+[<\[{]?(?:[0-9]{4}|yyyy|year)|©)[^\n]*$"
#: Widths that known texts may be wrapped at, besides their own lines and unwrapped blocks.
WIDTHS = range(40, 121)
BLANK_LINES = r"\n(?:[ \t\r]*\n)+"


def canonical(text: Column) -> Column:
    """One form for all ways to write a licence."""
    form = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    form = F.concat(F.lit(" "), F.trim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for other, usual in SPELLINGS:
        form = F.replace(form, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(form)


def known_digests(spark, known=KNOWN) -> DataFrame:
    """``license, digest`` of the known texts: a table as long as the list of them."""
    texts = spark.createDataFrame([(name, form) for name, text in known for form in wrappings(text)], "license string, text string")
    return texts.select("license", F.md5(canonical(F.col("text"))).alias("digest")).distinct()


def whole_texts() -> list[tuple[str, str]]:
    """``license, text`` of the licences and headers stored with this module."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [(f.name.removesuffix(".txt").removesuffix(".header"), f.read_text(encoding="utf-8")) for f in files]


def wrappings(text: str) -> list[str]:
    """The text as it stands, with unwrapped blocks, and wrapped at ``WIDTHS``, as far as its form differs.

    White space has no part in the form, but a copyright line does: after wrapping, it can begin
    or end elsewhere.
    """
    blocks = [" ".join(b.split()) for b in re.split(BLANK_LINES, text) if b.strip()]
    fill = lambda b, width: textwrap.fill(b, width, break_long_words=False, break_on_hyphens=False)
    forms = [text, "\n\n".join(blocks), *("\n\n".join(fill(b, width) for b in blocks) for width in WIDTHS)]
    return [*{" ".join(re.sub(COPYRIGHT_LINE, " ", f.lower()).split()): f for f in reversed(forms)}.values()]


def _blocks(text: Column) -> Column:
    """Canonical blocks of lines between blank ones; what is only a copyright line is none."""
    return F.filter(F.transform(F.split(text, BLANK_LINES), lambda b: canonical(b)), lambda b: b != "")


def known_blocks(spark, texts=None) -> DataFrame:
    """``license, text, blocks, at, digest``: each block of the known texts of several lines, by place."""
    forms = [(name, form) for name, t in (whole_texts() + [*KNOWN] if texts is None else texts) for form in wrappings(t.strip("\n"))]
    rows = [(k, name, form) for k, (name, form) in enumerate(forms)]
    known = spark.createDataFrame(rows, "text int, license string, body string").withColumn("b", _blocks(F.col("body")))
    return known.select("license", "text", F.size("b").alias("blocks"), F.posexplode("b").alias("at", "block")).withColumn("digest", F.md5("block")).drop("block")


def license_blocks(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, license, scope, times`` with scope ``block``: known texts that stand as runs of blocks.

    A text of one line is not looked for here when it stands as one line: that is scope ``line``.
    Rows are told apart by id and text; repeated rows count as often as they stand in the table.
    """
    known = known_blocks(docs.sparkSession) if known is None else known
    text = text_of(text_col)
    wrapped = F.transform(F.split(text, BLANK_LINES), lambda b: F.struct(canonical(b).alias("form"), F.btrim(b, F.lit(" \t\r\n")).contains("\n").alias("wrapped")))
    blocks = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("row"), F.filter(wrapped, lambda b: b["form"] != "").alias("b"))
    blocks = blocks.select("id", "row", F.posexplode("b").alias("no", "b")).select("id", "row", "no", F.md5("b.form").alias("digest"), "b.wrapped")
    met = blocks.join(F.broadcast(known), "digest").withColumn("start", F.col("no") - F.col("at"))
    whole = met.groupBy("id", "row", "license", "text", "blocks", "start").agg(F.count("*").alias("n"), F.size(F.collect_set("at")).alias("places"), F.max("wrapped").alias("wrapped"))
    whole = whole.where("places = blocks AND (blocks > 1 OR wrapped)")
    whole = whole.groupBy("id", "row", "license", "start").agg(F.max(F.expr("n div blocks")).alias("copies"))
    return whole.groupBy("id", "license").agg(F.sum("copies").alias("times")).select(F.col("id").alias(id_col), "license", F.lit("block").alias("scope"), "times")


def licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, license, scope, times``: the licences a document is or contains as whole lines or blocks.

    ``scope`` is ``document``, ``line`` or ``block`` (with the given list ``known``: not ``block``); a text of one line counts as both. Null and empty
    texts match nothing; rows with one id are counted together, a null id counts as an id. An empty table
    gives no rows; texts of any length are read whole; other columns of the table are not read.
    Text on the line of a copyright notice is not compared.
    """
    blocks = license_blocks(docs, None, id_col, text_col) if known is None else None
    known = known_digests(docs.sparkSession, [*KNOWN, *whole_texts()]) if known is None else known
    text = text_of(text_col)
    unit = F.concat(
        F.array(F.struct(F.lit("document").alias("scope"), text.alias("text"))),
        F.transform(F.split(text, "\n"), lambda line: F.struct(F.lit("line").alias("scope"), line.alias("text"))),
    )
    units = docs.select(F.col(id_col).alias("id"), F.explode(unit).alias("unit")).select("id", "unit.scope", F.md5(canonical(F.col("unit.text"))).alias("digest"))
    found = units.join(F.broadcast(known), "digest")
    found = found.groupBy("id", "license", "scope").agg(F.count("*").alias("times")).withColumnRenamed("id", id_col)
    return found if blocks is None else found.unionByName(blocks)

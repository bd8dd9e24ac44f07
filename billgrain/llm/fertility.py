"""Quality rules on tokeniser fertility.

A public vocabulary is measured on each document: characters per token, the share of tokens
that are bytes it had to fall back to, and the entropy of the tokens. What is usual differs by
language, so each language (or script, where no language is given) has a band of its own from
the quartiles of its documents, the steadier the more documents it has, and documents outside of it are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrain.llm.common import short_batches, stored, text_of
from billgrain.llm.words import REMEMBERED, piece_tokeniser, remembered
from billgrain.session import counted_keys

SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "
#: Scripts told apart where a language is missing, and the code points of their letters.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "hiragana": ((0x3040, 0x309F),),
    "katakana": ((0x30A0, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)),
}
#: Documents of a group that weigh as much as its whole script.
SHRINK = 100
#: Measures with a band, and the decimals that their quartiles are taken of.
ROUNDED = {"strayed": 2, "byte_share": 4, "evenness": 4}
#: Texts measured at once.
TEXTS = 200

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")


class Vocabulary:
    """Words seen by a worker, with the tokens of each."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.tokens, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, split: list[list[bytes]], path: str) -> np.ndarray:
        new = [*set().union(*split).difference(self.place)]
        if len(self.place) + len(new) > REMEMBERED:
            self.__init__()
            new = [*set().union(*split)]
        if new:
            found = piece_tokeniser(path).encode([w.decode() for w in new], num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.starts = np.r_[self.starts, len(self.tokens) + np.cumsum(sizes) - sizes]
            self.sizes = np.r_[self.sizes, sizes]
            self.tokens = np.r_[self.tokens, np.fromiter((t for f in found for t in f), np.int32, int(sizes.sum()))]
        n = sum(map(len, split))
        return np.fromiter((self.place[w] for words in split for w in words), np.int64, n)


def _runs(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, starts and lengths of runs of equal (owner, value); owners come in order."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    starts = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])]) if len(o) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.r_[starts, len(o)])


def measure(texts: list[str], path: str, window: int = 3) -> dict[str, np.ndarray]:
    """The counts of each text, and the entropy of its tokens in bits."""
    vocabulary = remembered(f"vocabulary {path}", Vocabulary)
    pieces = piece_tokeniser(path)
    byte_tokens = remembered(f"bytes {path}", lambda: np.array([pieces.is_byte(i) or pieces.is_unknown(i) for i in range(pieces.vocab_size())]))
    split = [t.encode().split() for t in texts]  # of bytes: at ASCII white space only
    n, sizes = len(texts), np.array([len(w) for w in split], np.int64)
    code, owner = vocabulary.places(split, path), np.repeat(np.arange(n), sizes)
    per_text = lambda where, weights=None: np.bincount(where, weights, n)
    # positions in windows of words that the text holds twice or more
    at = np.flatnonzero(owner[window - 1 :] == owner[: len(owner) - window + 1]) if len(owner) >= window else np.zeros(0, np.int64)
    value = np.zeros(len(at), np.int64)
    for k in range(window):
        _, value = np.unique(value * (len(vocabulary.place) + 1) + code[at + k], return_inverse=True)
    order, starts, lengths = _runs(owner[at], value)
    again = at[order[np.repeat(lengths >= 2, lengths)]]
    covered = np.zeros(len(owner), bool)
    for k in range(window):
        covered[again + k] = True
    # tokens: each text's different words, as often as it has them
    order, starts, times = _runs(owner, code)
    word, whose = code[order[starts]], owner[order[starts]]
    size = vocabulary.sizes[word]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    token = vocabulary.tokens[np.repeat(vocabulary.starts[word], size) + inner]
    whose, times = np.repeat(whose, size), np.repeat(times, size)
    order, starts, _ = _runs(whose, token)
    often = np.add.reduceat(times[order], starts) if len(starts) else np.zeros(0, np.int64)
    total = per_text(whose, times)
    spread = per_text(whose[order[starts]], often * np.log2(np.maximum(often, 1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(total > 0, np.log2(np.maximum(total, 1)) - spread / np.maximum(total, 1), 0.0)
    found = {
        "n_words": sizes,
        "word_chars": np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([_repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": per_text(owner[covered]).astype(np.int64),
        "n_tokens": total.astype(np.int64),
        "n_byte_tokens": per_text(whose, times * byte_tokens[token]).astype(np.int64),
    }
    return found | {"entropy": entropy}


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _script_ranges() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last code point and script of each range, in order."""
    ranges = sorted((first, last, k) for k, script in enumerate(SCRIPTS.values()) for first, last in script)
    first, last, script = np.array(ranges).T
    return first, last, script


def script_of(text: str) -> str:
    """The script of most letters of the whole text; equal counts go to the first of ``SCRIPTS``."""
    if text.isascii():
        return "latin" if text.lower() != text.upper() else "none"
    first, last, script = remembered("script ranges", _script_ranges)
    letters = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    at = np.searchsorted(first, letters, "right") - 1
    counts = np.bincount(script[at[(at >= 0) & (letters <= last[at])]], minlength=len(SCRIPTS))
    return [*SCRIPTS][int(counts.argmax())] if counts.any() else "none"


def measures(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``id, lang, script`` and the measures of each row. ``vocabulary`` is a file of ``sentencepiece``."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "lang", "script", *COUNTS, "entropy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                some = batch.slice(at, TEXTS)
                texts = some.column("text").to_pylist()
                found = {"script": [script_of(t) for t in texts]} | measure(texts, vocabulary)
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("lang"), *[pa.array(found[x]) for x in names[2:]]], names)

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang string, script string, {', '.join(f'{c} long' for c in COUNTS)}, entropy double")


def fertility_verdicts(
    docs: DataFrame,
    vocabulary: str,
    width: float = 2.5,
    entropy_width: float = 3.0,
    byte_slack: float = 0.1,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
) -> DataFrame:
    """The measures of each row, ``base_failed``, ``reasons`` and ``kept``.

    A text of few tokens strays more from what is usual, as the root of their number, so
    ``strayed`` is the distance of its characters per token from its group's median times that
    root; the share of bytes and the entropy as a share of the most that so many tokens can have
    are measured from the group's medians, too. A group is a language, or a script where no
    language is given. Bands reach from the quartiles of these distances over the group's documents
    that pass the base rules (fewer than 50 words, or more than half of the words in repeated
    windows of three, fail): ``width`` quartile distances for ``strayed``, ``entropy_width`` below
    for the entropy, ``byte_slack`` and ``width`` above for the bytes.

    A group of n documents keeps its own middle, and its quartiles count n against ``SHRINK`` of its
    script, all of whose documents are measured from the middles of their own groups; bands are
    wider by one part in the root of n, as a middle of few is less sure. So groups of all sizes go
    one way. Quartiles are exact over rounded values, whichever way the rows are split.
    Null and empty texts have no words and fail the base rules. Repeated rows have equal results.
    An empty table gives no rows; a null id stays null; texts of any length are measured whole, in
    the memory of one task; other columns of the table are not read.
    """
    rows = stored(measures(docs, vocabulary, id_col, text_col, lang_col))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    tokens = F.greatest("n_tokens", F.lit(1))
    rows = rows.select(
        "*",
        failed.alias("base_failed"),
        (F.col("word_chars") / tokens).alias("chars_per_token"),
        (F.col("n_byte_tokens") / tokens).alias("byte_share"),
        F.when(F.col("n_tokens") > 1, F.col("entropy") / F.log2("n_tokens")).otherwise(F.lit(0.0)).alias("evenness"),
    )
    rows = rows.withColumn("band", F.coalesce("lang", "script"))
    usual = rows.where("NOT base_failed")
    middle = lambda c: F.percentile(F.round(c, 4), 0.5).alias(f"{c}_mid")
    _, middles = counted_keys(usual.groupBy("band").agg(F.count("*").alias("_n"), *[middle(c) for c in ("chars_per_token", "byte_share", "evenness")]))
    rows = rows.join(middles, "band", "left").withColumns(
        {
            "strayed_off": (F.col("chars_per_token") - F.col("chars_per_token_mid")) * F.sqrt(tokens),
            "byte_share_off": F.col("byte_share") - F.col("byte_share_mid"),
            "evenness_off": F.col("evenness") - F.col("evenness_mid"),
        }
    )
    usual = rows.where("NOT base_failed")
    for by in ("band", "script"):
        quartiles = [F.percentile(F.round(f"{c}_off", digits), [0.25, 0.75]).alias(f"{c}_{by}") for c, digits in ROUNDED.items()]
        _, spread = counted_keys(usual.groupBy(by).agg(*quartiles))
        rows = rows.join(spread, by, "left")

    def edge(measure: str, wide: float) -> Column:
        n = F.col("_n")
        low, high = ((n * F.col(f"{measure}_band")[k] + SHRINK * F.col(f"{measure}_script")[k]) / (n + SHRINK) for k in (0, 1))
        room = (high - low) * (abs(wide) + 1 / F.sqrt(n))
        return low - room if wide < 0 else high + room

    reasons = F.array_compact(
        F.array(
            F.when(F.col("strayed_off") < edge("strayed", -width), "few characters per token"),
            F.when(F.col("strayed_off") > edge("strayed", width), "many characters per token"),
            F.when(F.col("byte_share_off") > edge("byte_share", width) + byte_slack, "bytes"),
            F.when(F.col("evenness_off") < edge("evenness", -entropy_width), "low entropy"),
        )
    )
    return rows.select(
        F.col("id").alias(id_col),
        "band",
        *COUNTS,
        "entropy",
        "chars_per_token",
        "byte_share",
        "evenness",
        "base_failed",
        F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(reasons).alias("reasons"),
        (~F.col("base_failed") & (F.size(reasons) == 0)).alias("kept"),
    )


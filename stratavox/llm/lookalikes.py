"""One consistent form of text that looks the same (problem 9).

Method: compatibility normalisation in composed form, full case folding, mapped white space and removal of default-ignorable
characters, once per distinct value of a batch. Look-alike letters of Latin, Cyrillic and Greek are read as one letter.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sized_join import sized_join
from ..session import Stash

#: Documents of one text that are listed together, and texts that show the same that meet at once.
CHUNK_DOCS = 1000
CHUNK_TEXTS = 500

# Letters of Cyrillic and Greek that are drawn like a Latin letter. The rule: upright letters whose shape in common text fonts is that of one
# Latin letter of the same kind (capital for capital, small for small), as in the public table of confusable characters, reduced to letters of these three
# scripts; letters that merely resemble one (ρ and p, ι and i, ѵ and v, α and a) stay what they are.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "ү": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
}
# Look-alikes in comparisons, where case does not count: also the small letters of mapped capitals (к as К). Letters whose two cases look like
# different Latin letters (Ν as N, ν as v; Ӏ as I, ӏ as l) keep both readings, since one reading would make n of every v and i of every l.
ANY_CASE = {c.lower(): v.lower() for c, v in {**CYRILLIC, **GREEK}.items() if c != c.lower()} | CYRILLIC | GREEK
# Ranges of default-ignorable code points (Unicode DerivedCoreProperties).
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
LINE_BREAKS = "\u000b\u000c\u0085\u2028\u2029"


class _PerCharacter(dict):
    """A translation table that works out each character once, when it is first met."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, code: int):
        self[code] = value = self.rule(chr(code))
        return value


def _ignorable(ch: str) -> bool:
    return any(a <= ord(ch) <= b for a, b in IGNORABLE)


def _blank(ch: str) -> str | None:
    if ch in LINE_BREAKS or ch == "\r":
        return "\n"
    return " " if ch == "\t" or unicodedata.category(ch) == "Zs" else None


def _shown(ch: str) -> str:
    """What a reader sees of a decomposed character: nothing, a blank, the plain letter, or itself. Case and superscripts stay."""
    if _ignorable(ch):
        return ""
    if (blank := _blank(ch)) is not None:
        return blank
    kind = unicodedata.decomposition(ch)
    if kind.startswith(("<wide>", "<narrow>")):
        ch = unicodedata.normalize("NFKD", ch)
    return "".join(CYRILLIC.get(c) or GREEK.get(c) or c for c in ch)


@cache
def _tables() -> tuple[dict, dict]:
    return _PerCharacter(_shown), _PerCharacter(lambda c: "" if _ignorable(c) else _blank(c) or ANY_CASE.get(c, c))


def _ascii_blanks(text: str) -> str:
    """What the tables make of a text of ASCII characters only."""
    return text.replace("\t", " ").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n")


def shown_form(text: str) -> str:
    """Equal for texts that show the same characters: width, composition, invisible characters, kinds of blank and look-alike
    letters are levelled; case, accents, superscripts and dashes stay. Every blank counts: carriage return and line feed are two line breaks, not one."""
    if text.isascii():
        return _ascii_blanks(text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_tables()[0]))


def consistent_form(text: str) -> str:
    """The consistent form for comparisons: compatibility normalisation, full case folding, mapped blanks, nothing invisible, plain
    letters for look-alikes in either case (``ANY_CASE``), composed."""
    if text.isascii():
        return _ascii_blanks(text.casefold())
    plain = unicodedata.normalize("NFKD", text).translate(_tables()[1])
    folded = unicodedata.normalize("NFKD", plain.casefold()).translate(_tables()[1])
    return unicodedata.normalize("NFC", folded)


def _per_distinct(series: pd.Series, form) -> pd.Series:
    codes, values = pd.factorize(series)
    made = pd.Series([form(v) for v in values], dtype=object)
    return pd.Series([made[c] if c >= 0 else None for c in codes], index=series.index, dtype=object)


@F.pandas_udf(T.StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    return _per_distinct(texts, consistent_form)


@F.pandas_udf(T.StringType())
def _shown_texts(texts: pd.Series) -> pd.Series:
    return _per_distinct(texts, shown_form)


def _with_plain(text: str | Column, plain, other) -> Column:
    """``plain`` of ASCII texts, which stays in the JVM, and ``other`` (a Python function, which gets no ASCII text) of the rest; null stays null."""
    t = F.col(text) if isinstance(text, str) else text
    ascii_only = F.length(t) == F.octet_length(t)
    blanks = F.translate(plain(t), "\t\r\x0b\x0c", " \n\n\n")
    return F.when(ascii_only, blanks).otherwise(other(F.when(~ascii_only, t)))


def consistent_text(text: str | Column) -> Column:
    """The consistent form of a text column; null stays null."""
    return _with_plain(text, F.lower, _consistent)


def shown_text(text: str | Column) -> Column:
    """What the texts of a column show; null stays null."""
    return _with_plain(text, lambda t: t, _shown_texts)


def _key(text: Column) -> Column:
    """A 128-bit key of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def _class_keys(docs: DataFrame, id_col: str, text: str | Column) -> DataFrame:
    """id, coarse (key of the consistent form), exact (key of the text), written once; both null for a null text. The texts themselves go no further."""
    t = F.col(text) if isinstance(text, str) else text
    return Stash(docs.select(F.col(id_col).cast("long").alias("id"), _key(consistent_text(t)).alias("coarse"), _key(t).alias("exact")), "looks").df


def _classes(texts: DataFrame) -> DataFrame:
    """coarse, class_id (smallest id), n_docs, n_texts of the classes of different texts coarse, exact, first, n."""
    return texts.groupBy("coarse").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_texts"))


def look_classes(docs: DataFrame, id_col: str, text: str | Column) -> DataFrame:
    """Every document with its class of equal consistent form: id, class_id (smallest id), n_docs, n_texts (different texts, within the class).

    Documents with a null text are classes of their own, with a null class_id if their id is null too; empty texts are equal to each other. One pass over
    the texts; only keys and ids are shuffled. Classes are made with map-side aggregation, so a text that a third of all documents share costs one row per task;
    documents meet them again by ``sized_join``, which spreads the rows of a large class. A class of one document needs no join.
    """
    keyed = _class_keys(docs, id_col, text)
    texts = keyed.filter("coarse is not null").groupBy("coarse", "exact").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = Stash(_classes(texts).filter("n_docs > 1"), "classes", {"n": F.count("*")})
    one = F.expr("1L")
    joined = sized_join(keyed, shared.df, ["coarse"], "left", row_bytes=64, rows=shared.seen["n"])
    return joined.select("id", F.when(F.col("n_docs").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_docs", one).alias("n_docs"), F.coalesce("n_texts", one).alias("n_texts"))


def look_alike_pairs(docs: DataFrame, id_col: str, text: str | Column, chunk_docs: int = CHUNK_DOCS, chunk_texts: int = CHUNK_TEXTS) -> DataFrame:
    """Pairs (id_a < id_b) of documents whose texts are different strings but show the same characters.

    Documents of a class of one consistent form with several texts (as in ``look_classes``) are candidates; only their texts are read again, for the exact
    check of what is shown, which tells case, accents, superscripts and dashes apart. Copies of one string do not pair with each other. Null texts
    and null ids pair with nothing.

    Only keys and ids are shuffled. Texts are reduced to distinct ones by map-side aggregation and paired as texts, then expanded to their documents, so
    copies of one text never meet, however many there are. Nothing is joined in one piece that can grow: the texts that show the same are dealt to
    blocks of about ``chunk_texts``, which meet block by block, and the documents of a text to lists of about ``chunk_docs``, which meet list by list.
    """
    keyed = _class_keys(docs, id_col, text)
    several = Stash(keyed.filter("coarse is not null").groupBy("coarse", "exact").agg(F.expr("1L").alias("n"), F.min("id").alias("first")).transform(_classes).filter("n_texts > 1").select("coarse"), "several", {"n": F.count("*")})
    candidates = sized_join(keyed.filter("id is not null"), several.df, ["coarse"], row_bytes=48, rows=several.seen["n"]).select("id", "exact").distinct()
    wanted = Stash(candidates, "candidates", {"n": F.count("*")})
    ids = wanted.df.select(F.col("id").alias("__id")).distinct()
    again = sized_join(docs.select(F.col(id_col).cast("long").alias("__id"), (F.col(text) if isinstance(text, str) else text).alias("__text")).filter("__text is not null"), ids, ["__id"], row_bytes=16, rows=wanted.seen["n"])
    checked = Stash(again.select(F.col("__id").alias("id"), _key(F.col("__text")).alias("exact"), _key(shown_text("__text")).alias("fine")).distinct(), "shown").df

    copies = checked.groupBy("fine", "exact").agg(F.count("*").alias("n"))
    sizes = copies.groupBy("fine").agg(F.count("*").alias("texts")).filter("texts > 1").withColumn("blocks", F.ceil(F.col("texts") / chunk_texts).cast("int"))
    lists = F.ceil(F.col("n") / chunk_docs).cast("int")
    texts = Stash(sized_join(copies, sizes, ["fine"], row_bytes=48).select("fine", "exact", lists.alias("lists"), "blocks", F.pmod(F.xxhash64("exact"), F.col("blocks")).cast("int").alias("block")), "texts", {"n": F.count("*")})
    # block i meets every block j >= i once: on the left it is sent to all j, on the right to all i
    left = texts.df.select("fine", "exact", "lists", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = texts.df.select("fine", F.col("exact").alias("exact_b"), F.col("lists").alias("lists_b"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    pairs = left.join(right, ["fine", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("exact") < F.col("exact_b")))
    spread = pairs.withColumn("list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).withColumn("list_b", F.explode(F.sequence(F.lit(0), F.col("lists_b") - 1)))

    held = sized_join(checked, texts.df.select("exact", "lists"), ["exact"], row_bytes=32, rows=texts.seen["n"])
    dealt = held.groupBy("exact", F.pmod(F.xxhash64("id"), F.col("lists")).cast("int").alias("list")).agg(F.collect_list("id").alias("ids"))
    stored = Stash(dealt, "lists", {"n": F.count("*"), "longest": F.max(F.size("ids"))})
    size = {"row_bytes": 8 * (stored.seen["longest"] or 0) + 32, "rows": stored.seen["n"]}
    first = sized_join(spread.select("exact", "list", "exact_b", "list_b"), stored.df, ["exact", "list"], **size)
    other = stored.df.select(F.col("exact").alias("exact_b"), F.col("list").alias("list_b"), F.col("ids").alias("ids_b"))
    both = sized_join(first, other, ["exact_b", "list_b"], **size).select(F.explode("ids").alias("id"), "ids_b").select("id", F.explode("ids_b").alias("other"))
    return both.filter(F.col("id") != F.col("other")).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()

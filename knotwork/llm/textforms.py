"""One form for texts that look the same: compatibility composition, full case folding, mapped white space, no invisible characters.

Both forms go through these steps: canonical decomposition; every character to its compatibility parts, white space to a blank, invisible
characters to nothing; full case folding; composition; one blank for a run of them. The full form is the result. The visual form
leaves what a reader can tell apart: it doesn't fold case and keeps raised and lowered digits, fractions, circled and spelled-out
signs as they are; and it gives letters of different scripts that have one shape one letter, for which no Unicode form provides. Both work on
distinct values: equal texts of a batch are normalised once.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import Crowded, block_join, skew_join
from ..session import materialize

#: The code points with the property Default_Ignorable_Code_Point, as ranges.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

#: Marks of annotations, which are not ignorable by that property but show nothing by themselves either.
ANNOTATION = ((0xFFF9, 0xFFFB),)

#: Letters that have the shape of a Latin letter, script by script, and the Latin letters in the same order.
SAME_SHAPE = (
    ("АВЕЅІЈКМНОРСТУХҮԌԚԜѴӀ", "ABESIJKMHOPCTYXYGQWVI"),  # Cyrillic capitals
    ("аеһіјорсѕухүԁԛԝѵӏ", "aehijopcsyxydqwvl"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek capitals
    ("αγικνορυϲϳ", "ayikvopucj"),  # Greek small letters
    ("ՕՏօհոսզց", "OSohnuqg"),  # Armenian
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ⲞⲟⲢⲣⲤⲥⲎⲔⲘⲚⲦⲬ", "OoPpCcHKMNTX"),  # Coptic
    ("ɡɑÐƉ", "gaĐĐ"),  # Latin letters that differ in nothing a reader sees
    ("ӔӕӘәкГПФф", "ÆæƏəkΓΠΦφ"),  # Cyrillic letters with the shape of other Latin letters, or of Greek ones
    ("ⲄⲠⲪⲫⲖⲆⲐⲑ", "ΓΠΦφΛΔΘθ"),  # Coptic letters with the shape of Greek ones
)
#: Hyphens that have the shape of the ASCII one.
HYPHENS = "‐‑⁃﹣－"

_ALWAYS = {"wide", "narrow", "font", "noBreak", "initial", "medial", "final", "isolated", "vertical", "small"}
_LETTERS = {"compat", "square"}
_SPACES = re.compile(r"\s+")


def _looks_like_its_parts(ch: str) -> bool:
    """Whether a reader takes a compatibility character for its parts: forms of width, font and place, and joined letters."""
    mapping = unicodedata.decomposition(ch)
    tag = mapping[1 : mapping.index(">")]
    if tag in _ALWAYS:
        return True
    letter = unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nl"
    return tag in _LETTERS and letter and ch != "ſ" and all(unicodedata.category(p)[0] in "LM" for p in unicodedata.normalize("NFKD", ch))


@functools.cache
def _table(visual: bool) -> dict[int, str | None]:
    """What becomes of each character after canonical decomposition: the step both forms share."""
    table: dict[int, str | None] = {}
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if ch.isspace() or kind in ("Zs", "Zl", "Zp") or code == 0x2800:
            table[code] = " "
        elif kind == "Cc":
            table[code] = None
        elif code > 127 and unicodedata.decomposition(ch).startswith("<") and (not visual or _looks_like_its_parts(ch)):
            table[code] = unicodedata.normalize("NFKD", ch)
    for low, high in IGNORABLE + (ANNOTATION if visual else ()):
        table.update(dict.fromkeys(range(low, high + 1)))
    if visual:
        shapes = {ord(a): b for there, here in SAME_SHAPE for a, b in zip(there, here, strict=True)} | {ord(h): "-" for h in HYPHENS}
        for code, parts in table.items():
            if parts and parts != " ":
                table[code] = parts.translate(shapes)
        table |= {code: unicodedata.normalize("NFD", to) for code, to in shapes.items()}
    return table


def _form(text: str, visual: bool) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFD", text).translate(_table(visual))
        if not visual:  # folding may bring out characters to be mapped
            text = unicodedata.normalize("NFD", text.casefold()).translate(_table(False)).casefold()
        text = unicodedata.normalize("NFC", text)
    else:
        text = text if text.isprintable() else text.translate(_table(visual))
        text = text if visual else text.casefold()
    return _SPACES.sub(" ", text).strip(" ")


def visual_form(text: str) -> str:
    """The form in which two texts are equal if a reader can't tell them apart."""
    return _form(text, True)


def full_form(text: str) -> str:
    """Compatibility composition with full case folding, one blank for any white space, nothing invisible."""
    return _form(text, False)


def _per_distinct(make: Callable[[str], object], kind: str) -> Callable[[Column | str], Column]:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            codes, distinct = pd.factorize(texts, use_na_sentinel=True)
            made = pd.Series([*map(make, distinct), None], dtype=object)  # -1 is NULL
            yield made.iloc[codes].reset_index(drop=True)

    return run


def _digest(text: str) -> str:
    return hashlib.blake2b(visual_form(text).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def normalized(text: Column | str, visual: bool = False) -> Column:
    """The full form of a text, or the visual one. NULL stays NULL; a text of white space only becomes empty."""
    return _per_distinct(visual_form if visual else full_form, "string")(text)


def visual_key(text: Column | str) -> Column:
    """A 128-bit digest of the visual form, as hexadecimal text: what has to travel to compare texts."""
    return _per_distinct(_digest, "string")(text)


def look_alike_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, form_key, spelling): texts with one form_key look the same, those with one spelling are the same.

    NULL and empty texts are left out. Written once, as each text is normalised once.
    """
    given = docs.where(F.col(text_col) != "").select(F.col(id_col), F.col(text_col).alias("__t"))
    return materialize(given.select(id_col, visual_key("__t").alias("form_key"), F.xxhash64("__t").alias("spelling")), "forms")


def look_alike_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b): records whose texts differ in code points but look the same, id_a < id_b, each pair once.

    Spellings are paired first and records afterwards, so copies of one spelling never meet each other: the work follows
    the number of pairs returned.
    """
    forms = look_alike_classes(docs, id_col, text_col).select(F.col(id_col).alias("id"), "form_key", "spelling")
    several = forms.groupBy("form_key").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("form_key")
    open_ = materialize(skew_join(forms, several, "form_key", "left_semi").distinct(), "spelled")
    kinds = open_.select("form_key", "spelling").distinct()
    s1, s2 = kinds.select("form_key", F.col("spelling").alias("s1")), kinds.select("form_key", F.col("spelling").alias("s2"))
    two = block_join(s1, s2, ["form_key"], "s2", keep_keys=True).where("s1 < s2")
    first = open_.select("form_key", F.col("spelling").alias("s1"), F.col("id").alias("x"))
    second = open_.select("form_key", F.col("spelling").alias("s2"), F.col("id").alias("y"))
    crowded = Crowded.of(first, ["form_key", "s1"])  # a page copied very often
    met = block_join(two, first, ["form_key", "s1"], "x", keep_keys=True, crowded=crowded).select("form_key", "s2", "x")
    met = block_join(met, second, ["form_key", "s2"], "y", crowded=crowded.renamed(["form_key", "s2"])).where("x <> y")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

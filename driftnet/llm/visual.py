"""One form for texts that look the same but differ in their characters.

Method: a text is exploded to positioned code points, each is replaced through a
broadcast join with a table of decompositions and look-alikes, combining marks
are ordered by class, the rest is put together again and recomposed. The table
is built from the character database by rule, plus a short list of look-alike
letters; it is bounded by the size of Unicode (about 20,000 rows).

What is replaced: canonical decompositions; width variants, ligatures, presentation
forms, typeface variants and blanks of any width; letters of other scripts with the
same shape; hyphens that only forbid a break. What is removed: characters
without a visible form. What stays: letter case, marks, superscripts, circled and
squared forms, and every other sign, since a reader sees those.

Texts are made distinct and written once, and shuffled before they are exploded, so the
exploded rows never move. A text that holds many rows is split when they are joined back. A text of ASCII characters only is its own form.

Defined results: null has no form; a text of invisible characters has the empty
form; texts of any length and repeated rows are allowed; empty tables give none.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftnet.llm.words import INVISIBLE
from driftnet.operators.skew import spread_join
from driftnet.session import cut_lineage

# fixed values: letters of other scripts, and the Latin letter of the same shape
LOOK_ALIKES = (
    # Cyrillic
    "а=a с=c ԁ=d е=e һ=h і=i ј=j ӏ=l о=o р=p ԛ=q ѕ=s ѵ=v ԝ=w х=x у=y "
    "А=A В=B С=C Е=E Н=H І=I Ј=J К=K М=M О=O Р=P Ԛ=Q Ѕ=S Т=T Ѵ=V Ԝ=W Х=X У=Y Ү=Y Ӏ=I ү=y ԍ=G Ԍ=G "
    # Greek
    "α=a ϲ=c ι=i ϳ=j κ=k ν=v ο=o ρ=p υ=u γ=y χ=x "
    "Α=A Β=B Ϲ=C Ε=E Η=H Ι=I Ϳ=J Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X Ζ=Z "
    # Armenian
    "ց=g հ=h յ=j ո=n օ=o զ=q ս=u Ս=U Տ=S Օ=O Լ=L "
    # Latin variants
    "ɑ=a ɡ=g ꞌ=' "
    # Cherokee
    "Ꭺ=A Ᏼ=B Ꮯ=C Ꭰ=D Ꭼ=E Ꮐ=G Ꮋ=H Ꭻ=J Ꮶ=K Ꮮ=L Ꮇ=M Ꮲ=P Ꮪ=S Ꭲ=T Ꮩ=V Ꮃ=W Ꮓ=Z "
    # Coptic
    "ⲟ=o ⲣ=p ⲥ=c ⲭ=x Ⲏ=H Ⲓ=I Ⲕ=K Ⲙ=M Ⲛ=N Ⲟ=O Ⲣ=P Ⲥ=C Ⲧ=T Ⲭ=X "
    # hyphens
    "‐=- ‑=-"
)
# fixed values: compatibility characters that look different from what they stand for
KEPT = "ſ№ϐϑϒϕϖϰϱϴϵ…‥℀℁℅℆"
_TAGS = {"<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}


@functools.cache
def _look_alikes() -> dict[str, str]:
    return dict(pair.split("=") for pair in LOOK_ALIKES.split(" ") if pair)


def _keeps_shape(ch: str) -> bool:
    """Whether a compatibility decomposition shows the same signs: not for spacing
    marks, parenthesised or numbered forms and letters of the Hangul alphabet."""
    o = ord(ch)
    name = unicodedata.name(ch, "")
    return not (
        ch in KEPT
        or 0x3131 <= o <= 0x318E
        or name.startswith(("PARENTHESIZED", "CIRCLED", "DIGIT", "NUMBER"))
        or (unicodedata.category(ch) in ("Sk", "Lm") and not name.startswith(("HALFWIDTH", "FULLWIDTH")))
    )


def shown(ch: str) -> str:
    """What a character shows: a sequence of base characters and marks."""
    if INVISIBLE.fullmatch(ch):
        return ""
    alike = _look_alikes().get(ch)
    if alike:
        return alike
    if unicodedata.category(ch) == "Zs":
        return " "
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0].startswith("<"):
        parts = parts[1:] if parts[0] in _TAGS and _keeps_shape(ch) else []
    if not parts:
        o = ord(ch)
        # Hangul syllables have no entry: they are decomposed by arithmetic
        return unicodedata.normalize("NFD", ch) if 0xAC00 <= o <= 0xD7A3 else ch
    return "".join(shown(chr(int(p, 16))) for p in parts)


@functools.cache
def _table_rows() -> tuple[tuple[str, list[tuple[str, int]]], ...]:
    rows = []
    for o in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000 or 0xE000 <= o < 0xF900 or 0x30000 <= o < 0xE0000 or o >= 0xE0200:
            continue
        ch = chr(o)
        to = shown(ch)
        if to != ch or unicodedata.combining(ch):
            rows.append((ch, [(x, unicodedata.combining(x)) for x in to]))
    return tuple(rows)


def character_table(spark: SparkSession) -> DataFrame:
    """ch, shows array<struct<to, class>>: all characters that do not show
    themselves and all combining marks."""
    return spark.createDataFrame(list(_table_rows()), "ch string, shows array<struct<to:string,class:int>>")


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@F.pandas_udf(T.StringType())
def _recompose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _plain(text: Column) -> Column:
    return ~text.rlike("[^\\x00-\\x7F]")


def consistent_forms(texts: DataFrame, text: str = "text") -> DataFrame:
    """(key, text, form) of each distinct non-null text."""
    distinct = cut_lineage(texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct())  # read three times
    ascii_only = distinct.where(_plain(F.col("text"))).select(text_key(F.col("text")).alias("key"), "text", F.col("text").alias("form"))
    other = distinct.where(~_plain(F.col("text"))).select(text_key(F.col("text")).alias("key"), "text").repartition("key")
    points = other.select("key", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    mapped = points.join(F.broadcast(character_table(texts.sparkSession)), "ch", "left")
    own = F.array(F.struct(F.col("ch").alias("to"), F.lit(0).alias("class")))
    parts = mapped.select("key", "pos", F.posexplode_outer(F.coalesce("shows", own)).alias("sub", "part"))
    in_order = Window.partitionBy("key").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)
    runs = parts.select("key", "pos", "sub", "part.*").withColumn("run", F.sum(F.when(F.col("class") == 0, 1).otherwise(0)).over(in_order))
    entry = F.when(F.col("to").isNotNull(), F.struct("run", "class", "pos", "sub", "to"))
    built = runs.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("chars"))
    forms = built.select("key", _recompose(F.array_join(F.transform("chars", lambda x: x["to"]), "")).alias("form"))
    return ascii_only.unionByName(other.join(forms, "key").select("key", "text", "form"))


def recognised(rows: DataFrame, titles: DataFrame, text: str = "text") -> DataFrame:
    """Rows with title_id and title of each title that their text looks like;
    columns of rows that are called so are replaced. titles has title_id and title."""
    names = titles.where(F.col("title").isNotNull()).select("title_id", "title")
    shown_titles = names.join(consistent_forms(names, "title").select(F.col("text").alias("title"), "form"), "title")
    alike = cut_lineage(consistent_forms(rows, text).join(shown_titles, "form").select(F.col("text").alias("__text"), "title_id", "title"))
    rows = rows.drop("__text", "title_id", "title")
    return spread_join(rows.withColumn("__text", F.col(text)), alike, "__text", rows.columns).select(*rows.columns, "title_id", "title")

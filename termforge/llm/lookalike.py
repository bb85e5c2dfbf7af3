"""One consistent form for texts that look the same but are stored with different characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from termforge.session import written

# Letters and signs of other kinds that are drawn like the one on the right.
DRAWN_ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "h", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï",
    "Օ": "O", "Տ": "S", "օ": "o", "ɡ": "g", "ɑ": "a", "\u00b5": "μ", "\u2126": "Ω", "\u212a": "K", "\u212b": "\u00c5",
    "\u2010": "-", "\u2011": "-", "\u2212": "-", "\u2215": "/", "\u2044": "/", "\u2217": "*", "\u2236": ":", "\u201a": ",", "\u2024": ".", "ǃ": "!", "ǀ": "|",
    "\u037e": ";", "\u0387": "\u00b7",
}
# Spaces that don't break, the wide space, and those of other widths.
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Single characters drawn as several letters, as ranges of code points: ligatures, Roman numerals.
DRAWN_AS_SEVERAL = [(0xFB00, 0xFB06), (0x2160, 0x217F)]
# Characters without a visible mark, as ranges of code points.
INVISIBLE_RANGES = [
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5),
    (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB),
]
INVISIBLE = "".join(chr(c) for a, b in INVISIBLE_RANGES for c in range(a, b + 1))


def _widths() -> dict[str, str]:
    """Full-width and half-width forms to the usual ones; a half-width voicing mark to the mark that combines."""
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFF9E), *range(0xFFE0, 0xFFEF)] if unicodedata.name(chr(c), "")}
    forms = {a: b for a, b in forms.items() if len(b) == 1}
    return forms | {"\uff9e": "\u3099", "\uff9f": "\u309a", "\uffe3": "\u00af"}


def _styled() -> dict[str, str]:
    """Mathematical letters and digits to the plain ones, and Roman numerals of one letter; Greek ones drawn like Latin letters to these."""
    codes = [*range(0x1D400, 0x1D800), *(c for a, b in DRAWN_AS_SEVERAL for c in range(a, b + 1))]
    plain = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in codes if unicodedata.name(chr(c), "")}
    return {a: b for a, b in plain.items() if len(b) == 1 and a != b}


def several_map() -> dict[str, str]:
    """Ligatures and Roman numerals of several letters, and these letters."""
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in DRAWN_AS_SEVERAL for c in range(a, b + 1)}
    return {a: b for a, b in forms.items() if len(b) > 1}


def _spelled(c: Column) -> Column:
    """The text with ligatures and numerals spelled out; only texts that have any are gone through."""
    out, chars = c, several_map()
    for a, b in chars.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(c.rlike(f"[{''.join(chars)}]"), out).otherwise(c)


def alike_map() -> tuple[str, str]:
    """Arguments of translate(): characters, and what stands for them; those beyond the end of the second are deleted."""
    pairs = _widths() | _styled() | dict.fromkeys(SPACES, " ")
    pairs = {a: DRAWN_ALIKE.get(b, b) for a, b in pairs.items()} | DRAWN_ALIKE
    return "".join(pairs) + INVISIBLE, "".join(pairs.values())


def tidy_map() -> tuple[str, str]:
    """As alike_map(), but without letters and signs of other kinds: usual widths, ordinary spaces, nothing invisible."""
    pairs = _widths() | _styled() | dict.fromkeys(SPACES, " ")
    return "".join(pairs) + INVISIBLE, "".join(pairs.values())


def alike(c: Column) -> Column:
    """The text with look-alike characters, widths and spaces brought to one, and without what can't be seen; accents as they are."""
    return F.translate(_spelled(c), *alike_map())


def tidy(c: Column) -> Column:
    """As alike(), but letters and signs of other kinds stay."""
    return F.translate(_spelled(c), *tidy_map())


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def consistent(c: Column) -> Column:
    """A row-wise consistent form: alike(), with accents composed. Only texts beyond ASCII, which composing may change, go to Python."""
    mapped = alike(c)
    return F.coalesce(_composed(F.when(mapped.rlike(r"[^\x00-\x7F]"), mapped)), mapped)


def consistent_classes(df: DataFrame, value: str, within: list[str]) -> DataFrame:
    """Classes of values that look the same, and the canonical member of each.

    Per `within` columns, look-alike-mapped values are grouped under Spark's accent- and case-sensitive UNICODE collation, which holds
    differently composed accents equal and passes over control characters. The canonical member is the one that differs least from its own
    mapped form: plain before changed, then shorter, then first by code points; so it doesn't depend on the order of rows.

    Returns within + (look, canonical, lo, hi), where lo and hi are the first and last value of the class, so lo <> hi tells that it has several; `look` is collated, so a join on it follows the same equality. Rows with a
    null value or a null within column are left out.
    """
    spark = df.sparkSession
    src, dst = alike_map()
    df = df.withColumn("__spelled", _spelled(F.col(value)))
    cols = "".join(f"`{c}`, " for c in within)
    given = " AND ".join([f"`{value}` IS NOT NULL", *(f"`{c}` IS NOT NULL" for c in within)])
    return spark.sql(
        f"""SELECT {cols}look, min(struct(plain, length(v) AS n, v)).v AS canonical, min(v) AS lo, max(v) AS hi
        FROM (SELECT {cols}`{value}` AS v, collate(translate(__spelled, :src, :dst), 'UNICODE') AS look,
                     `{value}` <> translate(__spelled, :src, :dst) AS plain FROM {{df}} WHERE {given})
        GROUP BY {cols}look""",
        args={"src": src, "dst": dst},
        df=df,
    )


def with_consistent(df: DataFrame, value: str, within: list[str], out: str = "canonical") -> DataFrame:
    """df's rows with the canonical member of their class joined back; null values and rows with a null within column keep their value."""
    classes = consistent_classes(df, value, within).where("lo <> hi").drop("lo", "hi")
    keyed = df.withColumn("__look", F.collate(alike(F.col(value)), "UNICODE"))
    on = F.col("d.__look") == F.col("c.look")
    for c in within:
        on = on & (F.col(f"d.{c}") == F.col(f"c.{c}"))
    joined = keyed.alias("d").join(classes.alias("c"), on, "left")
    return joined.select("d.*", F.coalesce(F.col("c.canonical"), F.col(f"d.{value}")).alias(out)).drop("__look")


def with_one_form(df: DataFrame, value: str, out: str = "canonical") -> DataFrame:
    """df's rows with the one form of all values of the whole table that look the same, so that equal-looking values come out equal.

    The form is the canonical member of the class over all values, with usual widths and spaces, accents composed and nothing invisible, so
    a value without a partner is put right too. A value of printable ASCII is its own form and only says which form others take; just the
    distinct values beyond it are grouped. Null stays null.
    """
    beyond = F.coalesce(F.col(value).rlike(r"[^\t\n\r -~]"), F.lit(False))
    odd = written(df.where(beyond).select(value).distinct(), "odd")
    looks = odd.select(alike(F.col(value)).alias(value)).distinct()
    plain = df.where(~beyond).select(value).join(looks, value, "left_semi").distinct()
    classes = consistent_classes(odd.unionByName(plain), value, []).select("look", "canonical")
    keyed = odd.withColumn("__look", F.collate(alike(F.col(value)), "UNICODE")).alias("d").join(classes.alias("c"), F.col("d.__look") == F.col("c.look"))
    forms = keyed.select(F.col(f"d.{value}").alias("__value"), _composed(tidy(F.col("c.canonical"))).alias(out))
    put = df.where(beyond).join(forms, F.col(value) == F.col("__value")).drop("__value")
    return put.unionByName(df.where(~beyond).withColumn(out, F.col(value)))


def _members(df: DataFrame, id_col: str, fields: list[str], within: list[str]) -> DataFrame:
    """(id, within, field, canonical, value) of the rows whose value belongs to a class of several forms.

    Two different strings can only look the same if one of them holds a character beyond printable ASCII, so only groups of `within` with
    such a value go on.
    """
    odd = F.lit(False)
    for f in fields:
        odd = odd | F.coalesce(F.col(f).rlike(r"[^\t\n\r -~]"), F.lit(False))
    df = df.select(id_col, *within, *fields)
    df = df.join(df.where(odd).select(*within).distinct(), within, "left_semi")
    rows = df.select(
        F.col(id_col).alias("id"), *within, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    )
    rows = rows.where(F.col("value").isNotNull())
    key = [*within, "field"]
    classes = consistent_classes(rows, "value", key).where("lo <> hi")
    keyed = rows.withColumn("look", F.collate(alike(F.col("value")), "UNICODE"))
    on = F.col("r.look") == F.col("c.look")
    for c in key:
        on = on & (F.col(f"r.{c}") == F.col(f"c.{c}"))
    members = keyed.alias("r").join(classes.alias("c"), on).select("r.id", *[f"r.{c}" for c in key], "c.canonical", "r.value")
    return written(members, "alike")


def alike_members(df: DataFrame, id_col: str, fields: list[str], within: list[str]) -> DataFrame:
    """(id, field, class_id, canonical, n_links): each value that has look-alikes, with its class's smallest id and how many rows it is linked to.

    A row is linked to those of its class whose string is another, so this tells all that alike_pairs() does in one row per
    member, however large a class is. Counts are made per form and per class, with partial sums before the shuffle.
    """
    members = _members(df, id_col, fields, within)
    key = [*within, "field", "canonical"]
    forms = members.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    classes = forms.groupBy(*key).agg(F.sum("n").alias("n_class"), F.min("first").alias("class_id"))
    forms = forms.join(classes, key).select(*key, "value", "class_id", (F.col("n_class") - F.col("n")).alias("n_links"))
    return members.join(forms, [*key, "value"]).select("id", "field", "class_id", "canonical", "n_links")


def alike_pairs(df: DataFrame, id_col: str, fields: list[str], within: list[str], block: int = 10_000) -> DataFrame:
    """(id_a, id_b, field): rows that agree in `within` and whose values of a field are different strings that look the same.

    Classes with several forms are found by consistent_classes(), and pairs are made
    between the forms of a class first and only then between rows, so rows that share a form are never compared with each
    other, and every row that is made is a result. Rows of a form are cut into blocks of about `block` by a hash of the id,
    so no task makes the pairs of a large class alone; alike_members() gives the same links without pairs. Null fields and rows with null
    within take no part; repeated ids are taken as one row each.
    """
    members = _members(df, id_col, fields, within)
    key = [*within, "field", "canonical"]
    forms = members.groupBy(*key, "value").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    others = forms.select(*key, F.col("value").alias("other"))
    pairs = forms.join(others, key).where("value <> other")
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part")
    one = members.join(pairs, [*key, "value"]).select(F.col("id").alias("id_a"), *key, "value", "other", part)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")
    wide = pairs.where("blocks > 1").select(*key, "value", "other", "blocks")
    two = members.select(F.col("id").alias("id_b"), *key, F.col("value").alias("other"))
    plain = one.where("part = 0").join(two, [*key, "other"])
    # forms of several blocks, of which there are few, meet a copy of the other side in each block beyond the first
    copied = two.join(wide, [*key, "other"]).select("id_b", *key, "value", "other", every).where("part > 0")
    more = one.where("part > 0").join(copied, [*key, "value", "other", "part"])
    both = plain.select("id_a", "id_b", "field").unionAll(more.select("id_a", "id_b", "field"))
    return both.where("id_a < id_b").distinct()

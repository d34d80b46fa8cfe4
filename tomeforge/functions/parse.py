"""Parsing of the small notations that catalogues use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def first_int(text: Column, grouped: bool = False) -> Column:
    """The first integer of a text ("3-5" is 3); with ``grouped``, points and commas are taken out first ("1.000" is 1000)."""
    text = F.regexp_replace(text, "[.,]", "") if grouped else text
    return F.regexp_extract(text, r"(-?\d+)", 1).try_cast("int")


def norm_dice(text: Column) -> Column:
    """The first NdM+K in lower case, else the first integer, else the text; empty is null."""
    dice = F.nullif(F.lower(F.regexp_extract(text, r"(\d+[dD]\d+(?:[+-]\d+)?)", 1)), F.lit(""))
    number = F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))
    return F.coalesce(dice, number, F.nullif(strip(text), F.lit("")))


def dice_mean(text: Column) -> Column:
    """Mean of a dice expression, the number itself for a number, else null."""
    pattern = r"^(\d+)[dD](\d+)([+-]\d+)?"
    n, faces, bonus = (F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2, 3))
    return F.when(text.rlike(pattern), (faces + 1) / 2 * n + F.coalesce(bonus, F.lit(0))).otherwise(text.try_cast("double"))


def split_list(text: Column) -> Column:
    """Parts between commas, semicolons and line feeds, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, "[,;\n]"), lambda x: F.trim(x)), lambda x: x != "")


def range_mean(text: Column) -> Column:
    """The middle of a range ("3-4" is 3.5), the leading number of other texts, else 0."""
    text = F.trim(text)
    pattern = r"^(\d+)\s*[-–]\s*(\d+)$"
    low, high = (F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2))
    return F.when(text.rlike(pattern), (low + high) / 2).otherwise(F.coalesce(F.regexp_extract(text, r"^(-?\d+)", 1).try_cast("double"), F.lit(0.0)))


def resource_mean(text: Column) -> Column:
    """Mean of a resource: leading number, else dice of six faces with bonus, "variável" 15, other text 5, none 0."""
    text = F.lower(F.trim(text))
    lead = F.regexp_extract(text, r"^(\d+)(?!\d*d)", 1).try_cast("double")
    n, bonus = (F.regexp_extract(text, r"^(\d+)d\+?(\d+)?", k).try_cast("double") for k in (1, 2))
    dice = F.floor(n * 3.5 + F.coalesce(bonus, F.lit(0)) + 0.5)
    return F.when(text.isNull() | (text == ""), 0.0).when(text.isin("variável", "variavel"), 15.0).otherwise(F.coalesce(lead, dice, F.lit(5.0)))


def cost(text: Column) -> Column:
    """Signed cost of an advantage text, e.g. "1 ponto", "-2 pontos", "1 a 3 pontos" (the first); none is 0."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(text, "[–−]", "-"), r"(-?\d+)", 1).try_cast("int"), F.lit(0))


def spell_cost(text: Column) -> Column:
    """Cost in magic points, 1 where none is written."""
    return F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("int"), F.lit(1))


def spell_potency(effect: Column, spell: Column) -> Column:
    """Three times the number of dice in the effect, else the cost."""
    return F.coalesce(F.regexp_extract(effect, r"(\d+)d", 1).try_cast("int") * 3, spell)


def dice_stats(text: Column) -> Column:
    """Least, mean and greatest result and the probability of each extreme of NdM+K."""
    pattern = r"(\d+)d(\d+)([+-]\d+)?"
    n, faces = (F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2))
    bonus = F.coalesce(F.regexp_extract(text, pattern, 3).try_cast("int"), F.lit(0))
    return F.struct((n + bonus).alias("least"), ((faces + 1) / 2 * n + bonus).alias("mean"), (n * faces + bonus).alias("greatest"), F.pow(1 / faces, n).alias("extreme"))

"""Ingredients with historical and modern measures out of record texts, and their volumes. Arrays and higher-order functions: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions.text import UNIT_FACTORS, WS, bound, clean_name, collapse, decimal_comma, historical_number, plain_number, trim_all

SCHEMA = "array<struct<name:string,amount:double,unit:string,modern_amount:double,modern_unit:string>>"

# patterns of measured ingredients (fixed values)
AMOUNT = rf"(\d+(?:{WS}*\d*/\d+)?)"
NAME = rf"[а-яё{WS[1:-1]}\-,()]+?"
STOP = r"(?=[.;,!\n]|\z)"
DASHED = rf"(?iu)([а-яё][а-яёa-z{WS[1:-1]}\-,()]+?){WS}*—{WS}*{AMOUNT}{WS}*золотник[а-я]*{WS}*\([^)]*?([\d,]+){WS}*г\)"
JUGS = rf"(?iu){AMOUNT}{WS}*штоф[а-я]*{WS}*\([^)]*?([\d,]+){WS}*л\){WS}*({NAME}){STOP}"
POUNDS = rf"(?iu){AMOUNT}{WS}*фунт[а-я]*{WS}*\([^)]*?([\d,]+){WS}*г\){WS}*({NAME}){STOP}"
LISTED = rf"(?iu)({NAME}),{WS}*({NAME})(?:,{WS}*({NAME}))?(?:,{WS}*({NAME}))?{WS}*—{WS}*по{WS}*{AMOUNT}{WS}*золотник[а-я]*{WS}*\([^)]*?([\d,]+){WS}*г\)"
#: Keyword passes: (name, unit, modern unit, pattern); a line end stops the search for the keyword.
KEYWORDS = (
    ("водка", "штоф", "л", rf"(?iu){AMOUNT}{WS}*штоф[а-я]*[^\n\r]*?водк[а-я]*"),
    ("сахар", "фунт", "г", rf"(?iu){AMOUNT}{WS}*фунт[а-я]*[^\n\r]*?сахар[а-я]*"),
    ("вода", "штоф", "л", rf"(?iu){AMOUNT}{WS}*штоф[а-я]*[^\n\r]*?вод[ыеу]"),
)
SPIRIT_JUGS = rf"(?iu){AMOUNT}{WS}*штоф[а-я]*[^\n\r]*?водк"


def item(name: Column, amount: Column, unit: str, modern: Column, modern_unit: str) -> Column:
    return F.struct(name.alias("name"), amount.alias("amount"), F.lit(unit).alias("unit"), modern.alias("modern_amount"), F.lit(modern_unit).alias("modern_unit"))


def _simple(text: Column, pattern: str, name: int, amount: int, modern: int, unit: str, modern_unit: str) -> Column:
    g = lambda h, k: F.regexp_extract(h, pattern, k)
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: item(clean_name(g(h, name)), historical_number(g(h, amount)), unit, decimal_comma(g(h, modern)), modern_unit))


def _listed(text: Column) -> Column:
    g = lambda h, k: F.regexp_extract(h, LISTED, k)

    def rows(h: Column) -> Column:
        names = F.filter(F.array(*[g(h, k) for k in range(1, 5)]), lambda n: F.char_length(trim_all(n)) > 2)
        cleaned = F.filter(F.transform(names, clean_name), lambda n: (n != "") & (n != "г") & ~n.contains("около"))
        return F.transform(cleaned, lambda n: item(n, historical_number(g(h, 5)), "золотник", decimal_comma(g(h, 6)), "г"))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(LISTED), F.lit(0)), rows))


def measured(text: Column) -> Column:
    """All measured ingredients, pattern by pattern, names longer than one character."""
    parts = F.concat(_simple(text, DASHED, 1, 2, 3, "золотник", "г"), _simple(text, JUGS, 3, 1, 2, "штоф", "л"), _simple(text, POUNDS, 3, 1, 2, "фунт", "г"), _listed(text))
    return F.filter(parts, lambda i: F.char_length(i["name"]) > 1).cast(SCHEMA)


def with_keywords(text: Column, found: Column) -> Column:
    """Add the main ingredients that keywords tell and whose exact name is not there yet."""
    for name, unit, modern_unit, pattern in KEYWORDS:
        amount = historical_number(F.regexp_extract(text, pattern, 1))
        found = bound(found, _grown(text, pattern, name, bound(amount, _new(name, unit, modern_unit))))
    return found


def _new(name: str, unit: str, modern_unit: str):
    return lambda x: F.array(item(F.lit(name), x, unit, x * UNIT_FACTORS[unit], modern_unit)).cast(SCHEMA)


def _grown(text: Column, pattern: str, name: str, new: Column):
    there = lambda f: F.coalesce(F.exists(f, lambda i: F.lower(i["name"]) == name), F.lit(False))
    return lambda f: F.when(text.rlike(pattern) & ~there(f), F.concat(f, new)).otherwise(f)


def merged(items: Column) -> Column:
    """One item per lower-cased name, in order of first place; modern amounts of the first one's modern unit are summed, others dropped."""
    cleaned = F.transform(F.filter(items, lambda i: F.char_length(i["name"]) > 1), lambda i: i.withField("name", clean_name(i["name"])))
    keyed = F.transform(cleaned, lambda i: F.struct(F.lower(i["name"]).alias("k"), i.alias("i")))

    def one(n: Column, every: Column) -> Column:
        mine = F.filter(every, lambda x: x["k"] == n)
        return bound(
            F.struct(mine.alias("mine"), F.get(mine, F.lit(0))["i"].alias("first")),
            lambda p: p["first"].withField("modern_amount", F.aggregate(
                F.filter(p["mine"], lambda x: x["i"]["modern_unit"].eqNullSafe(p["first"]["modern_unit"])), F.lit(0.0), lambda a, x: a + x["i"]["modern_amount"]
            )),
        )

    # names are cleaned once, whatever the number of items that share them
    return bound(keyed, lambda every: F.transform(F.array_distinct(F.transform(every, lambda x: x["k"])), lambda n: one(n, every))).cast(SCHEMA)


def spirit_volume(items: Column, text: Column) -> Column:
    """Litres of vodka and spirit among the items; else of all jugs of vodka in the text; else 1."""
    hit = lambda i: (i["modern_unit"] == "л") & (i["name"].contains("водк") | i["name"].contains("спирт"))
    told = F.aggregate(F.filter(items, hit), F.lit(0.0), lambda a, i: a + i["modern_amount"])
    jugs = F.regexp_extract_all(text, F.lit(SPIRIT_JUGS), F.lit(1))
    read = F.aggregate(F.transform(jugs, lambda x: historical_number(x) * UNIT_FACTORS["штоф"]), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.nullif(told, F.lit(0.0)), F.nullif(read, F.lit(0.0)), F.lit(1.0))


def per_litre(items: Column, base: Column) -> Column:
    return F.transform(items, lambda i: F.struct(*[i[c].alias(c) for c in ("name", "amount", "unit", "modern_amount", "modern_unit")], F.try_divide(i["modern_amount"], base).alias("amount_per_liter"), i["modern_unit"].alias("unit_per_liter"), base.alias("base_volume")))


def measures(items: Column) -> Column:
    return F.transform(items, lambda i: F.struct(i["name"].alias("name"), i["amount"].alias("historical_amount"), i["unit"].alias("historical_unit"), F.concat_ws(" ", plain_number(i["modern_amount"]), i["modern_unit"]).alias("modern_equivalent")))


def description(text: Column) -> Column:
    """What follows the first working step; else what follows the list of ingredients; else the whole text."""
    step = rf"(?iu)(?:Истолочь|Покрошив|Раздробив|После)([\s\S]*?)\z"
    take = rf"(?iu)Возьмите:[\s\S]*?(?=\n\n|\z)([\s\S]*?)\z"
    return F.when(text.rlike(step), collapse(trim_all(F.regexp_extract(text, step, 1)))).when(text.rlike(take), collapse(trim_all(F.regexp_extract(text, take, 1)))).otherwise(trim_all(text))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once, however many later ones are made of it: a generator, which the optimizer never copies."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_ingredients(records: DataFrame, strict: bool = True) -> DataFrame:
    """Records with ingredients, ingredients_per_liter, description and historical_measures; records without ingredients go.

    ``strict`` keeps the double count of a drink that both a jug and a keyword name.
    """
    text = F.col("content")
    out = once(records, "__found", measured(text))
    items = merged(with_keywords(text, F.col("__found")) if strict else F.col("__found"))
    out = out.select("*", F.explode(F.filter(F.array(items), lambda i: F.size(i) > 0)).alias("ingredients"))
    out = once(out, "base_volume", spirit_volume(F.col("ingredients"), text))
    return out.select(*records.columns, "ingredients", per_litre(F.col("ingredients"), F.col("base_volume")).alias("ingredients_per_liter"), description(text).alias("description"), measures(F.col("ingredients")).alias("historical_measures"))
